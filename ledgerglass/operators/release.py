"""The release rules: 38 gates over the tables of one release, numbered as in the catalogue's own rule book.

`tables` are the release's tables, all flat:

* products (code, atc, route, is_combo, inn_keys array, unresolved, has_insert)
* ingredients (inn, subset, sections array, products array)
* sections (code, title, text, char_count, no_file, is_stub, coverage, tables array of (cols, lossless),
  annexes array of (name, missing), annex_from, prior_review, prior_review_evidence, clauses array, tables_spliced)
* previous_sections (code, is_stub); manifest (code, no_file, char_count, file, sha256, effective); files (file, sha256)
* events (code, kind); pending (section, effective); dosage (inn, kind, section, quote)
* labels (id, licences array, text, adjust array); licences (licence, dosage), a licence once
* procedures (code, subset); sources (name, sha256, fetched_at); header (columns array); heads (name)
* annexes (name, url); annex_manifest (name, url); annex_files (name); index (bytes, entries)

Nulls count as missing. Every rule is an aggregate; what compares two tables is an equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import match_prefix
from ..functions.textnorm import nfc, strip
from . import gates
from .gates import Gate
from .mentions import mentions
from .tables import MARKER, marked_tables

# Sections and annexes whose state is known, by the number of the rule that reads them.
SEEDS = ["13.4.", "13.17.1.", "10.7.1.1.", "10.7.1.2.", "8.2.4.", "10.6.4.", "8.2.16."]  # 16
PROSE = ["13.15.", "13.10.", "13.11.", "13.16.", "10.6.4.", "10.7.1.1.", "8.2.1.", "13.3.1.", "10.7.1.2.", "8.2.16.", "13.4.", "13.5."]  # 21
ANNEX_OF = {"13.4.": "附表十", "13.5.": "附表十一", "13.17.1.": "附表三十二"}  # 22
SOURCES = ["nhi_csv", "tfda_json"]  # 25
COLUMNS_OF = {"13.17.2.": 8, "2.6.1.": 5, "8.2.4.11.": 8}  # 26
FRAGMENTS = ["9.41.", "1.6.2.2.", "8.2.4.11.", "4.2.9."]  # 34
NO_ANNEX = ["附表十六之二", "附表九之六"]  # 37


@dataclass(frozen=True)
class Policy:
    """What is curated by hand: lists of at most some hundred names each."""

    columns: list[str] = field(default_factory=list)
    canaries: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    preserve: list[str] = field(default_factory=list)
    bare_allowed: list[str] = field(default_factory=list)
    procedure_canaries: list[str] = field(default_factory=list)
    blocked_procedures: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    seeds: list[str] = field(default_factory=lambda: SEEDS)
    prose: list[str] = field(default_factory=lambda: PROSE)
    annex_of: dict[str, str] = field(default_factory=lambda: ANNEX_OF)
    columns_of: dict[str, int] = field(default_factory=lambda: COLUMNS_OF)
    sources: list[str] = field(default_factory=lambda: SOURCES)


@dataclass(frozen=True)
class Previous:
    """Counts of the last release; None where there is none."""

    products: int | None = None
    procedures: int | None = None
    annexes: int | None = None


def _true(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _has_annex(name: str) -> Column:
    return F.exists("annexes", lambda x: (x["name"] == name) & ~F.coalesce(x["missing"], F.lit(False)))


def _has_columns(count: int) -> Column:
    return F.exists("tables", lambda x: x["cols"] == count)


def _near(before: int | None) -> Column:
    n = F.count(F.lit(1))
    return F.lit(True) if before is None else n.between(0.9 * before, 1.1 * before)


def _all_found(id: int, name: str, table: str, column: str, ok: Column, wanted: list[str]) -> Gate:
    """Every wanted value occurs in a row that is right."""
    found = F.count_distinct(F.when(ok & F.col(column).isin(wanted), F.col(column)))
    return Gate(id, name, table, found == len(set(wanted)), F.concat(found.cast("string"), F.lit(f" of {len(set(wanted))}")))


def _each_holds(id: int, name: str, table: str, conditions: list[Column]) -> Gate:
    """Each condition holds in some row."""
    n = sum((F.coalesce(F.bool_or(c), F.lit(False)).cast("int") for c in conditions), F.lit(0))
    return Gate(id, name, table, n == len(conditions), F.concat(n.cast("string"), F.lit(f" of {len(conditions)}")))


def foreign_names(dosage: DataFrame) -> DataFrame:
    """Direct and sole quotes that name another ingredient of the table and not their own.

    Quotes are cut into words and names into their first word, so that it is an
    equi-join; then the whole name has to stand there. Names of fewer than six characters count only as one's own.
    """
    base = F.lower(F.substring_index("inn", " (", 1))
    names = dosage.select(F.col("inn").alias("other"), base.alias("name")).distinct().withColumn("word", F.regexp_extract("name", "[a-z]+", 0)).where("word <> ''")
    quotes = dosage.where(F.col("kind").isin("direct", "section_sole")).select("inn", base.alias("own"), F.lower(F.coalesce("quote", F.lit(""))).alias("quote")).distinct()
    own = F.rlike("quote", F.concat(F.lit(r"(?<![a-z])\Q"), F.col("own"), F.lit(r"\E(?![a-z])")))
    words = quotes.where(~own).withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all("quote", F.lit("[a-z]+"), 0))))
    return words.join(names, "word").where((F.col("other") != F.col("inn")) & mentions(F.col("quote"), F.col("name"))).select("inn", "quote").distinct()


def rewritten(heads: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """alias: those whose spelling the master uses while no name of the master contains what they are turned into.

    Aliases are curated, so they are a literal that each name is held against.
    """
    if not aliases:
        return heads.select(F.col("name").alias("alias")).limit(0)
    pairs = F.array(*(F.struct(F.lit(k.upper()).alias("alias"), F.lit(v.upper()).alias("into")) for k, v in aliases.items()))
    met = F.filter(pairs, lambda p: (p["alias"] == F.col("head")) | F.contains(F.col("head"), p["into"]))
    used = heads.where(~_empty("name")).select(F.upper(strip("name")).alias("head"))
    rows = used.select("head", met.alias("met")).select("head", F.inline("met"))
    seen = rows.groupBy("alias", "into").agg(F.bool_or(F.col("head") == F.col("alias")).alias("used"), F.bool_or(F.contains("head", F.col("into"))).alias("kept"))
    return seen.where("used and not kept").select("alias")


def views(tables: Mapping[str, DataFrame], policy: Policy) -> dict[str, DataFrame]:
    """The release's tables and what the rules read that takes more than one of them."""
    t = dict(tables)
    subset = t["ingredients"].where(_true("subset"))
    of_subset = subset.select("inn", F.explode_outer("products").alias("code"))
    inserts = t["products"].select("code", "route", _true("has_insert").alias("has_insert"))
    keys = t["products"].where(F.startswith("atc", F.lit("D07")) & ~_true("is_combo")).select(F.explode("inn_keys").alias("key")).withColumn("base", F.substring_index("key", " (", 1))
    shown = t["manifest"].where(~_true("no_file") & ~_empty("file")).select("code", "file", F.col("sha256").alias("expected"))
    licences = t["licences"].select(strip(nfc(F.col("licence"))).alias("licence"), strip(nfc(F.col("dosage"))).alias("dosage")).where("dosage <> ''")
    each = t["labels"].select("id", "text", "adjust", F.explode_outer("licences").alias("licence")).join(licences, "licence", "left")
    t |= {
        "subset_products": of_subset.where("code is not null").select("code").distinct().join(inserts, "code", "left"),
        "subset_inserts": of_subset.join(inserts, "code", "left").groupBy("inn").agg(F.bool_or(_true("has_insert")).alias("has_insert")),
        "subset_sections": subset.select(F.explode("sections").alias("code")).distinct(),
        "topical": keys.groupBy("base").agg(F.count_distinct("key").alias("n"), F.bool_or(F.col("key") == F.col("base")).alias("bare")),
        "turned": t["sections"].where(_true("is_stub")).select("code").join(t["previous_sections"].where(~_true("is_stub")).select("code"), "code", "left_semi"),
        "snapshots": shown.join(t["files"].select("file", F.col("sha256").alias("actual")), "file", "left"),
        "landed": t["pending"].where(~_empty("section") & ~_empty("effective")).join(t["manifest"].select(F.col("code").alias("section"), F.col("effective").alias("current")), "section"),
        "quotes": t["dosage"].join(t["sections"].select(F.col("code").alias("section"), "text"), "section", "left"),
        "foreign": foreign_names(t["dosage"]),
        "label_texts": each.groupBy("id").agg(F.bool_or(F.coalesce(F.col("text") == F.col("dosage"), F.lit(False))).alias("same"), F.first("text").alias("text"), F.first("adjust").alias("adjust")),
        "rewritten": rewritten(t["heads"], policy.aliases),
        "annex_state": t["annexes"].join(t["annex_manifest"].select("name", F.col("url").alias("known")), "name", "left").join(t["annex_files"].select("name", F.lit(True).alias("there")), "name", "left"),
    }
    return t


def rules(policy: Policy, previous: Previous) -> list[Gate]:
    """The 38 gates over `views`; numbers 6, 9, 10 and 12 are not in use."""
    n = F.count(F.lit(1))
    marks = F.flatten(F.transform("clauses", marked_tables))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    spliced = F.coalesce(F.sum("tables_spliced"), F.lit(0)) == F.coalesce(F.sum(size(marks)), F.lit(0))
    sound = F.count_if(_true(F.exists(marks, lambda m: m >= size(F.col("tables"))) | F.rlike("text", F.lit(MARKER)))) == 0
    annexes = F.count_if(F.col("annex_from").isNotNull())
    fragments = F.exists("clauses", lambda c: gates.fragment_run(F.regexp_replace(c, MARKER, "")))
    code = F.col("code")
    return [
        Gate(1, "products near the last count", "products", _near(previous.products), n.cast("string")),
        Gate(2, "columns of the master", "header", F.bool_and(F.col("columns") == F.array(*map(F.lit, policy.columns)).cast("array<string>")), n.cast("string")),
        gates.at_least(3, "sections", "sections", 500),
        gates.none(4, "texts are there", "manifest", ~_true("no_file") & (F.coalesce("char_count", F.lit(0)) == 0)),
        gates.none(5, "texts have a title or 20 characters", "sections", ~_true("no_file") & ~_empty("text") & _empty("title") & (F.coalesce("char_count", F.lit(0)) < 20)),
        gates.share_at_most(7, "names without an ingredient", "products", F.col("unresolved"), 0.02),
        gates.share_at_most(8, "other routes in the subset", "subset_products", F.col("route") == "OTHER", 0.05),
        Gate(11, "size of the index", "index", F.bool_and((F.col("bytes") < 300 * 1024) & (F.col("entries") > 200)), n.cast("string")),
        _all_found(13, "canary ingredients", "ingredients", "inn", _true("subset"), [c.upper() for c in policy.canaries]),
        gates.none(14, "no bare name beside its esters", "topical", F.col("base").isin([x.upper() for x in policy.preserve]) & ~F.col("base").isin([x.upper() for x in policy.bare_allowed]) & F.col("bare") & (F.col("n") > 1)),
        gates.none(15, "no section became a stub", "turned", F.lit(True)),
        _each_holds(16, "seed sections", "subset_sections", [match_prefix(code, F.lit(s)) | match_prefix(F.lit(s), code) for s in policy.seeds]),
        gates.none(17, "coverage in the subset", "sections", ~_true("no_file") & (F.col("coverage") < 0.70) & _any([match_prefix(code, F.lit(p)) for p in policy.prefixes])),
        gates.none(18, "no compatibility ideographs", "sections", F.rlike("text", F.lit(r"[\uF900-\uFAFF]"))),
        gates.none(19, "no ideographs in Latin names", "ingredients", F.rlike("inn", F.lit(r"(?s)^[\x00-\x7f].*[\u3400-\u9fff]"))),
        gates.none(20, "tables are lossless", "sections", F.exists("tables", lambda x: ~F.coalesce(x["lossless"], F.lit(False)))),
        gates.none(21, "prose has no tables", "sections", code.isin(policy.prose) & (size("tables") > 0)),
        _each_holds(22, "annexes are found", "sections", [(code == c) & _has_annex(a) for c, a in policy.annex_of.items()]),
        Gate(23, "number of annexes", "sections", F.lit(True) if previous.annexes is None else annexes <= max(2 * previous.annexes, previous.annexes + 15), annexes.cast("string")),
        gates.none(24, "flags have evidence", "sections", _true("prior_review") & _empty("prior_review_evidence")),
        _all_found(25, "sources are registered", "sources", "name", ~_empty("sha256") & ~_empty("fetched_at"), policy.sources),
        _each_holds(26, "columns of known tables", "sections", [(code == c) & _has_columns(w) for c, w in policy.columns_of.items()]),
        gates.none(27, "quotes are verbatim", "quotes", ~gates.verbatim(F.col("quote"), F.col("text"))),
        gates.none(28, "no dosage of another ingredient", "foreign", F.lit(True)),
        Gate(29, "procedures near the last count", "procedures", (n == 0) | _near(previous.procedures), n.cast("string")),
        _all_found(30, "canary procedures", "procedures", "code", _true("subset"), policy.procedure_canaries),
        gates.none(31, "blocked procedures", "procedures", _true("subset") & code.isin(policy.blocked_procedures)),
        Gate(32, "markers match tables", "sections", spliced & sound, F.coalesce(F.sum(size(marks)), F.lit(0)).cast("string")),
        gates.none(33, "label texts are verbatim", "label_texts", ~F.col("same") | F.exists("adjust", lambda q: ~F.contains(F.col("text"), q))),
        gates.none(34, "no new fragments of tables", "sections", fragments & ~code.isin(FRAGMENTS)),
        gates.none(35, "aliases keep the master's spelling", "rewritten", F.lit(True)),
        gates.none(36, "list of annex files is current", "annex_state", ~F.col("url").eqNullSafe(F.col("known")) | F.col("there").isNull()),
        gates.none(37, "references to annexes resolve", "sections", F.exists("annexes", lambda x: F.coalesce(x["missing"], F.lit(False)) & ~x["name"].isin(NO_ANNEX))),
        gates.share_at_least(38, "ingredients with an insert", "subset_inserts", F.col("has_insert"), 0.90),
        gates.none(39, "names are clean", "ingredients", F.rlike("inn", F.lit(r"(?i)[，,、；;]\s*$|\d+\s*(MG|ML|MCG|GM|IU|%)")) | (F.endswith("inn", F.lit(")")) & ~F.contains("inn", F.lit("(")))),
        gates.none(40, "snapshots are there and unchanged", "snapshots", F.col("actual").isNull() | (~_empty("expected") & (F.col("expected") != F.col("actual")))),
        gates.none(41, "no section without any text", "events", F.col("kind") == "fetch_failed"),
        gates.none(42, "pending updates are still pending", "landed", F.coalesce("current", F.lit("")) >= F.col("effective")),
    ]


def check(tables: Mapping[str, DataFrame], policy: Policy, previous: Previous | None = None, override: tuple[int, ...] = ()) -> DataFrame:
    """One row per rule: id, name, passed, message, overridden."""
    return gates.run(rules(policy, previous or Previous()), views(tables, policy), override)
