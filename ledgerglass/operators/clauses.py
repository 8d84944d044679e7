"""Rule texts: clauses with levels, flags with evidence, titles, coverage, annexes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.textnorm import strip
from .matching import CODE_IN_TEXT, coverage, matched_share  # noqa: F401  part of what is known of clauses

# Markers with their levels, negators, keywords of each flag, forms of annex names.
MARKERS = [
    (1, r"^\s*([一二三四五六七八九十]+)、"),
    (2, r"^\s*[（(]([一二三四五六七八九十]+)[）)]"),
    (1, r"^\s*(\d+)\."),
    (2, r"^\s*[（(](\d+)[）)]"),
    (3, r"^\s*([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩI]+)[.、]"),
    (4, r"^\s*([A-Z])[.、]"),
]
NEGATIONS = ["不需", "無需", "無須", "毋須", "免經", "免予", "不必", "非經"]
FLAGS = {
    "prior_review": ["事前審查"],
    "special_case": ["專案申請", "專案審查"],
    "consent_form": ["同意書"],
    "course_limited": ["療程"],
    "no_combination": ["不得併用", "不得合併使用", "擇一使用", "擇一"],
    "annual_limit": ["每年", "半年內"],
}
SPECIALIST = r"限([一-鿿]{2,6}?)專科醫師"
ANNEX_NAME = r"附表[一二三四五六七八九十百零〇\d]+(?:之[一二三四五六七八九十\d]+)?"
ANNEX_HEAD = r"^[◎●※★・\s]*附表[一二三四五六七八九十百零〇\d]+(?:之[一二三四五六七八九十\d]+)?\s*[：:、【（(\s]"
ANNEX_INLINE = r"[詳見參照如]\s*附表"
LINES = r"\R|[\x1c-\x1e]"


def level_of(line: Column, markers=MARKERS) -> Column:
    """Level of the first marker that a line begins with, null if it has none."""
    out = None
    for level, pattern in markers:
        out = F.when(line.rlike(pattern), level) if out is None else out.when(line.rlike(pattern), level)
    return out


def marker_of(line: Column, markers=MARKERS) -> Column:
    out = None
    for _, pattern in markers:
        out = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)) if out is None else out.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))
    return out


def is_annex_head(line: Column) -> Column:
    return line.rlike(ANNEX_HEAD) & ~F.substring(line, 1, 6).rlike(ANNEX_INLINE)


def split_clauses(docs: DataFrame, key: str, body: str, markers=MARKERS) -> DataFrame:
    """key, idx, marker, level, text, appendix: a clause is a marked line (or the lines before any, level 0) with those that follow.

    An annex heading begins a clause of level 1, and everything from the first one on is appendix.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), LINES)).alias("line_no", "line")).where(F.trim("line") != "")
    lines = lines.withColumn("head", is_annex_head(F.col("line"))).withColumn("level", F.when(F.col("head"), 1).otherwise(level_of(F.col("line"), markers))).withColumn("marker", F.when(~F.col("head"), marker_of(F.col("line"), markers)))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("idx", F.sum(F.col("level").isNotNull().cast("int")).over(w)).withColumn("appendix", F.max("head").over(w))
    first = F.struct("line_no", "level", "marker", "appendix")
    g = lines.groupBy(key, "idx").agg(F.min(first).alias("x"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return g.select(key, F.col("idx").cast("int").alias("idx"), F.col("x.marker").alias("marker"), F.coalesce("x.level", F.lit(0)).alias("level"), "text", F.col("x.appendix").alias("appendix"))


def occurrences(text: Column, word: str) -> Column:
    """0-based places of a word's occurrences that do not overlap."""
    parts = F.split(text, re.escape(word))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + len(word)).alias("at"), F.array_append(s["out"], s["at"] + F.length(p)).alias("out"))
    return F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda s: s["out"])


def is_negated(text: Column, at: Column, negations, reach: int = 6) -> Column:
    """Whether a negator stands in the `reach` characters before a place."""
    before = F.substring(text, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))
    return F.array_contains(F.array(*(F.contains(before, F.lit(n)) for n in negations)), True)


def flag_evidence(text, words, negations=NEGATIONS, around: int = 22) -> Column:
    """struct(kw, pos, quote) of the first occurrence that no negator voids, of the first word that has one; null without."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = []
    for word in words:
        good = F.filter(occurrences(t, word), lambda at: ~is_negated(t, at, negations))
        at = F.try_element_at(good, F.lit(1))
        low = F.greatest(at - around, F.lit(0))
        quote = strip(F.replace(F.substring(t, low + 1, at + len(word) + around - low), F.lit("\n"), F.lit(" ")))
        found.append(F.when(at.isNotNull(), F.struct(F.lit(word).alias("kw"), at.alias("pos"), quote.alias("quote"))))
    return F.coalesce(*found)


def extract_flags(docs: DataFrame, text: str, flags=FLAGS, negations=NEGATIONS) -> DataFrame:
    """`docs` with a boolean and an evidence column for every flag, the specialists named and the annexes referred to."""
    out = docs
    for name, words in flags.items():
        out = out.withColumn(f"{name}_ev", flag_evidence(text, words, negations)).withColumn(name, F.col(f"{name}_ev").isNotNull())
    t = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumn("specialist_only", F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(SPECIALIST), 1))))
    return out.withColumn("attachments", F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(ANNEX_NAME), 0))))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def split_title(code: pd.Series, text: pd.Series) -> pd.DataFrame:
    """The title line - the one that begins with the section's code, else the first that is not blank - with up to 12 lines it runs on into, and the rest."""

    def one(code, text):
        lines = re.split(r"\r\n|[\n\v\f\r\x1c-\x1e\x85  ]", text or "")
        bare = (code or "").rstrip(".")
        head = lambda s: re.match(rf"\s*{re.escape(bare)}\.?(?![\d.])", s) if bare else None
        at = next((i for i, s in enumerate(lines) if head(s)), next((i for i, s in enumerate(lines) if s.strip()), None))
        if at is None:
            return "", ""
        m = head(lines[at])
        title, dated = lines[at][m.end() if m else 0 :].strip(), False
        k = at + 1
        while k < len(lines) and k - at <= 12:
            dated = dated or bool(re.search(r"[（(]\s*\d{2,3}/\d{1,2}/\d{1,2}", title))
            balanced = title.count("（") + title.count("(") == title.count("）") + title.count(")")
            if re.match(r"\s*(?:\d+\.|[（(]?[一二三四五六七八九十]+[、）)])", lines[k]) or (dated and balanced and title[-1:] in "）)。：:"):
                break
            title += lines[k].strip()
            k += 1
        return title, "\n".join(lines[k:])

    return pd.DataFrame([one(c, t) for c, t in zip(code, text, strict=True)], columns=["title", "body"])


def relevant_start(clauses: DataFrame, key: str, hit: Column) -> DataFrame:
    """key, start: the clause to begin with - the nearest level-1 clause at or before the first hit; 0 without a hit or with at most three clauses."""
    g = clauses.groupBy(key).agg(F.min(F.when(hit, F.col("idx"))).alias("first_hit"), F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("level") == 1, F.col("idx"))).alias("tops"))
    before = F.array_max(F.filter("tops", lambda i: i <= F.col("first_hit")))
    return g.select(key, F.when(F.col("first_hit").isNull() | (F.col("n") <= 3), 0).otherwise(F.coalesce(before, F.col("first_hit"))).alias("start"))


def display_mode(is_node: Column, is_stub: Column, title_is_rule: Column, raw: Column) -> Column:
    return F.when(is_node, "node").when(is_stub, "stub").when(title_is_rule, "title").when(raw, "raw").otherwise("clauses")


def section_states(sections: DataFrame, clauses: DataFrame, as_of: str, least: int = 10) -> DataFrame:
    """sections (code, effective), clauses (code, text) -> code, is_stub, has_children, title_is_rule, is_future.

    A section whose clauses have fewer than `least` characters is a stub; a stub
    with sections below it points to them, one without is a rule in its title alone.
    """
    size = clauses.groupBy("code").agg(F.sum(F.length("text")).alias("size"))
    out = has_children(sections, "code").join(size, "code", "left").withColumn("is_stub", F.coalesce("size", F.lit(0)) < least)
    return out.select("code", "is_stub", "has_children", (F.col("is_stub") & ~F.col("has_children")).alias("title_is_rule"), F.coalesce(F.col("effective") > as_of, F.lit(False)).alias("is_future"))


def annex_paragraphs(annexes: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx, level 0, text: a clause for each line of a form that is not blank, without white space at its end; forms have no levels."""
    lines = annexes.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("idx", "line"))
    kept = lines.withColumn("line", F.regexp_replace("line", r"(?U)\s+$", "")).where("line <> ''")
    return kept.select(key, "idx", F.lit(0).alias("level"), F.col("line").alias("text"))


def image_notice(clauses: DataFrame, grids: DataFrame, key: str, least: int = 300) -> DataFrame:
    """clauses (key, text), grids (key, grid) -> key, visible, notice: whether an annex shows fewer than `least` characters, as drawings and scans do."""
    texts = clauses.select(key, F.length("text").alias("n"))
    cells = grids.select(key, F.aggregate(F.flatten("grid"), F.lit(0), lambda n, c: n + F.length(F.coalesce(c, F.lit("")))).alias("n"))
    return texts.union(cells).groupBy(key).agg(F.sum("n").alias("visible")).withColumn("notice", F.col("visible") < least)


#: Signs that a line refers to an annex, so it is no body of one.
REFERS = "◎●※★"


def annex_hosts(clauses: DataFrame, tabled: DataFrame, least: int = 200) -> DataFrame:
    """clauses (code, idx, text, appendix), tabled (code) -> name, code: annexes whose body lies in a section.

    A body counts if its clauses that are no references have more than `least`
    characters together or the section has tables; the first section names an annex.
    """
    real = clauses.where(F.col("appendix") & ~F.substring(F.regexp_replace("text", r"(?U)^\s+", ""), 1, 1).isin(*REFERS))
    size = real.groupBy("code").agg(F.sum(F.length("text")).alias("size")).join(tabled.select("code").distinct().withColumn("has", F.lit(True)), "code", "left")
    good = size.where((F.col("size") > least) | F.col("has")).select("code")
    names = real.join(good, "code", "left_semi").select("code", F.explode(F.regexp_extract_all(F.substring("text", 1, 60), F.lit(ANNEX_NAME), 0)).alias("name"))
    return names.groupBy("name").agg(F.min("code").alias("code"))


def has_children(sections: DataFrame, code: str) -> DataFrame:
    """`sections` with whether another code lies below: an equi-join on the proper ancestors of all codes."""
    from ..functions.codes import ancestors

    above = sections.select(F.explode(ancestors(code, proper=True)).alias(code)).distinct().withColumn("has_children", F.lit(True))
    return sections.join(above, code, "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def annex_registry(bodies: DataFrame, files: DataFrame) -> DataFrame:
    """name, source, body: section bodies win over files."""
    both = bodies.select("name", F.lit(0).alias("p"), F.lit("section").alias("source"), "body").union(files.select("name", F.lit(1).alias("p"), F.lit("file").alias("source"), "body"))
    return both.groupBy("name").agg(F.min_by(F.struct("source", "body"), F.struct("p", "source", "body")).alias("x")).select("name", "x.*")


def resolve_annexes(references: DataFrame, registry: DataFrame) -> DataFrame:
    """references (code, name) -> code, name, found (names), missing: exact names, else variants `name-…` or `name之…`."""
    names = registry.select(F.col("name").alias("have"))
    exact = references.join(names, F.col("name") == F.col("have"), "left")
    stem = names.select("have", F.explode(F.array_distinct(F.array(F.regexp_extract("have", r"^(.+?)-", 1), F.regexp_extract("have", r"^(.+?)之", 1)))).alias("stem")).where("stem <> ''")
    rest = exact.where("have is null").drop("have").join(stem, F.col("name") == F.col("stem"), "left").groupBy("code", "name").agg(F.array_sort(F.collect_set("have")).alias("found"))
    hit = exact.where("have is not null").groupBy("code", "name").agg(F.array_sort(F.collect_set("have")).alias("found"))
    return hit.union(rest).withColumn("missing", F.size("found") == 0)
