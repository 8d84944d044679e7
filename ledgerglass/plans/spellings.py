"""Queries on licences, routes, dates, grids, clauses and codes in their real spellings, with answers that differ from row to row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, names, routes
from ..operators import clauses, diffing, licence, tables
from .registry import query, table


def _case(choices: list[str], key: str = "p_partkey") -> str:
    return f"CASE {key} % {len(choices)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


_PREFIXES = [*licence.PREFIXES, "00", "9x"]
_SERIES = [*licence.PREFIXES.values(), None, None]
#: At least six digits; padding alone would cut longer numbers.
_DIGITS = "lpad(CAST(p_partkey AS STRING), greatest(6, length(CAST(p_partkey AS STRING))), '0')"
_URL = f"concat('https://example.org/a?licId=0&b=1&licId=', {_case([repr(p) for p in _PREFIXES])}, {_DIGITS}, CASE WHEN p_size % 2 = 0 THEN '&x=licence' ELSE '' END)"
_NO = f"concat({_case([repr(s) if s else repr('衛署') for s in _SERIES])}, '第', {_DIGITS}, CASE WHEN p_size % 7 = 0 THEN '' ELSE '號' END)"


@query(
    f"""SELECT p_partkey, {_case([repr(s) if s else 'NULL' for s in _SERIES])} AS series, CASE WHEN p_partkey % {len(_SERIES)} < {len(_SERIES) - 2} THEN CAST(p_partkey AS VARCHAR) END AS serial,
CASE WHEN p_partkey % {len(_SERIES)} < {len(_SERIES) - 2} AND p_size % 7 <> 0 THEN {_case([repr(s) if s else 'NULL' for s in _SERIES])} || ':' || CASE WHEN p_partkey = 0 THEN '0' ELSE CAST(p_partkey AS VARCHAR) END END AS numbered FROM part"""
)
def licence_series(spark, sf_dir):
    """Licences of all series from addresses and from numbers as they are printed; two prefixes that there are not, and numbers without their last character."""
    p = _part(spark, sf_dir).selectExpr("p_partkey", f"{_URL} AS url", f"{_NO} AS no")
    key, printed = licence.id_to_key(licence.id_from_url("url")), licence.number_to_key("no")
    # concat of a null key is null
    return p.select("p_partkey", key["series"].alias("series"), key["serial"].alias("serial"), F.concat(printed["series"], F.lit(":"), printed["serial"]).alias("numbered"))


_GROUP_NAMES = [(g, r) for r, gs in routes.GROUPS.items() for g in gs]
_WORDS = [w for _, ws in routes.KEYWORDS for w in ws]
_FORM_GROUP = f"CASE WHEN p_partkey % 3 = 0 THEN concat(' ', {_case([repr(g) for g, _ in _GROUP_NAMES], 'CAST(floor(p_partkey / 3) AS INT)')}, ' ') ELSE '未分類' END"
_DOSE_FORM = f"CASE WHEN p_partkey % 13 = 1 THEN {_case([repr(a) for a in routes.AMBIGUOUS], 'p_size')} WHEN p_partkey % 13 = 2 THEN p_type ELSE concat({_case([repr(w) for w in _WORDS])}, p_type, {_case([repr(w) for w in _WORDS], 'p_size * 7')}) END"


@query(
    f"""WITH f AS (SELECT p_partkey, trim({_FORM_GROUP}) AS g, {_DOSE_FORM} AS d FROM part)
SELECT p_partkey, CASE {' '.join(f"WHEN g = '{g}' THEN '{r}'" for g, r in _GROUP_NAMES)} {' '.join(f"WHEN d = '{a}' THEN 'OTHER'" for a in routes.AMBIGUOUS)} {' '.join(f"WHEN regexp_matches(d, '{'|'.join(ws)}') THEN '{r}'" for r, ws in routes.KEYWORDS)} ELSE 'OTHER' END AS route,
CASE WHEN g <> '未分類' THEN 'group' WHEN d IN ({', '.join(repr(a) for a in routes.AMBIGUOUS)}) THEN 'ambiguous' WHEN regexp_matches(d, '{'|'.join(_WORDS)}') THEN 'keyword' ELSE 'unknown' END AS source FROM f"""
)
def route_groups(spark, sf_dir):
    """Routes of all form groups and keywords, where two keywords of a form belong to different routes too."""
    p = _part(spark, sf_dir).selectExpr("p_partkey", f"{_FORM_GROUP} AS g", f"{_DOSE_FORM} AS d")
    return p.select("p_partkey", routes.derive("g", "d").alias("x")).select("p_partkey", "x.*")


_YEAR, _MONTH, _DAY = ("CAST(extract({} FROM o_orderdate) AS INT)".format(x) for x in ("YEAR", "MONTH", "DAY"))
_ROC, _M, _D = f"CAST({_YEAR} - 1911 AS STRING)", f"CAST({_MONTH} AS STRING)", f"CAST({_DAY} AS STRING)"
_PADDED = f"lpad({_M}, 2, '0'), lpad({_D}, 2, '0')"
_WRITTEN = _case([f"concat({_ROC}, '/', {_M}, '/', {_D})", f"concat(CAST({_YEAR} AS STRING), {_PADDED})", f"concat(' ', {_ROC}, {_PADDED}, ' ')", "'9991231'", f"concat({_ROC}, '/13/', {_D})", "''", f"concat({_ROC}, '年')"], "o_orderkey")
_ISO = f"concat(CAST({_YEAR} AS STRING), '-', lpad({_M}, 2, '0'), '-', lpad({_D}, 2, '0'))"
_NOTED = f"concat('規定（', {_ROC}, '/', {_M}, '/', {_D}, '、86/9/1）', CASE WHEN o_orderkey % 4 = 0 THEN '及(100/1/1說明)' WHEN o_orderkey % 4 = 1 THEN '(99/2/30)、（87/4/1，86/9/1）' ELSE '' END)"


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <= 2 THEN {_ISO} END AS day, CASE WHEN {_ISO} = '1997-09-01' THEN '' ELSE CASE WHEN {_ISO} < '1997-09-01' THEN {_ISO} || ',' ELSE '' END END || '1997-09-01' || CASE WHEN {_ISO} > '1997-09-01' AND (o_orderkey % 4 <> 1 OR {_ISO} < '1998-04-01') THEN ',' || {_ISO} ELSE '' END
|| CASE WHEN o_orderkey % 4 = 1 THEN ',1998-04-01' || CASE WHEN {_ISO} > '1998-04-01' AND {_ISO} < '2010-02-30' THEN ',' || {_ISO} ELSE '' END || ',2010-02-30' ELSE '' END AS revisions, CAST(CASE o_orderkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 11 ELSE 5 END AS INTEGER) AS n_pieces FROM orders"""
)
def dates_written(spark, sf_dir):
    """Days in every notation and in none, revisions out of order and repeated, and the pieces that a text with dates is shown in."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_WRITTEN} AS written", f"{_NOTED} AS noted")
    return o.select("o_orderkey", dates.roc_to_iso("written").alias("day"), F.array_join(dates.revision_dates("noted"), ",").alias("revisions"), F.size(dates.annotate_dates("noted")).alias("n_pieces"))


@query(
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'shape' WHEN 2 THEN 'ragged' WHEN 3 THEN 'sparse' WHEN 4 THEN 'long_cell' WHEN 5 THEN 'foreign' ELSE CASE WHEN p_size > 40 THEN 'shape' END END AS problem,
CAST(CASE p_partkey % 7 WHEN 1 THEN 1 WHEN 3 THEN 12 WHEN 6 THEN 2 ELSE 3 END AS INTEGER) AS width FROM part"""
)
def grid_problems(spark, sf_dir):
    """Grids with one column, with a short row, with hardly a cell, with a very long one, with what the page has not, and with many rows."""
    p = _part(spark, sf_dir)
    row = F.array("p_name", "p_brand", "p_type")
    many = F.transform(F.sequence(F.lit(1), F.col("p_size") * 2), lambda i: F.array(i.cast("string"), F.col("p_type")))
    empty = F.concat(F.array("p_name"), F.array_repeat(F.lit(""), 11))
    grids = [F.array(row, row), F.array(F.array("p_name"), F.array("p_brand")), F.array(row, F.array("p_name")), F.array(empty, F.array_repeat(F.lit(""), 12)), F.array(row, F.array(F.lit("a"), F.lit("b"), F.repeat("p_brand", 300))), F.array(row, F.array(F.lit("豈"), F.lit("a"), F.lit("b"))), many]
    grid = F.get(F.array(*grids), (F.col("p_partkey") % 7).cast("int"))
    source = F.concat("p_name", F.lit(" a b 0123456789 "), "p_brand", "p_type")
    g = p.select("p_partkey", grid.alias("g"), source.alias("s"))
    return g.select("p_partkey", tables.grid_problem(F.col("g"), F.col("s")).alias("problem"), tables.grid_score(F.col("g"))["width"].alias("width"))


#: Lines with every kind of marker, and lines that only look like one.
_MARKED = ["'前言'", "'一、總則'", "'（二）細項'", "'1.限'", "'(2)續'", "'Ⅲ、條件'", "'A.例外'", "'續行 1.0 mg'", "'  3.縮排'", "'附表十 同意書'", "'詳附表十 說明'", "''"]
_LEVEL = [0, 1, 2, 1, 2, 3, 4, 0, 1, 1, 0, 0]
_MARKER = [None, "一", "二", "1", "2", "Ⅲ", "A", None, "3", None, None, None]


def _line(i: int) -> str:
    return _case(_MARKED, f"(p_partkey * {i} + p_size)")


@query(
    f"""WITH l AS (SELECT p_partkey, unnest([1, 2, 3, 5, 7]) AS i, p_size FROM part), x AS (SELECT p_partkey, i, CAST((p_partkey * i + p_size) % {len(_MARKED)} AS INTEGER) + 1 AS k FROM l),
t AS (SELECT p_partkey, i, [{', '.join(_MARKED)}][k] AS line, [{', '.join(map(str, _LEVEL))}][k] AS level, [{', '.join(repr(m) if m else 'NULL' for m in _MARKER)}][k] AS marker, k = 10 AS head FROM x),
c AS (SELECT *, sum(CAST(level > 0 AS INTEGER)) OVER w AS idx, max(head) OVER w AS appendix FROM t WHERE line <> '' WINDOW w AS (PARTITION BY p_partkey ORDER BY i))
SELECT p_partkey, CAST(idx AS INTEGER) AS idx, arg_min(marker, i) FILTER (WHERE level > 0) AS marker, CAST(max(level) AS INTEGER) AS level, string_agg(line, chr(10) ORDER BY i) AS text, arg_min(appendix, i) AS appendix FROM c GROUP BY p_partkey, idx"""
)
def clause_levels(spark, sf_dir):
    """Clauses by the markers of rule texts in any order, and annexes from their heading on."""
    p = _part(spark, sf_dir).selectExpr("p_partkey", f"concat_ws(chr(10), {', '.join(_line(i) for i in (1, 2, 3, 5, 7))}) AS body")
    return clauses.split_clauses(p, "p_partkey", "body").select("p_partkey", "idx", "marker", "level", "text", "appendix")


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type || '|' || p_brand || ' (A+B)' WHEN 1 THEN p_type || ' (=A|' || p_brand WHEN 2 THEN p_brand WHEN 3 THEN p_type || ' (X (Y+Z) + W)|' || p_brand || '|' || p_size ELSE '' END AS parts,
CAST(CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS INTEGER) AS n FROM part"""
)
def component_parts(spark, sf_dir):
    """Components with signs in brackets, nested and left open, with empty parts, and none at all."""
    text = _case(["concat(p_type, ' + ', p_brand, ' (A+B)')", "concat(p_type, ' (=A + ', p_brand)", "concat(' + ', p_brand, '+')", "concat(p_type, ' (X (Y+Z) + W) +', p_brand, '+ ', p_size)", "' + '"])
    parts = names.split_components(F.col("t"))
    return _part(spark, sf_dir).selectExpr("p_partkey", f"{text} AS t").select("p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n"))


@query(
    """WITH s AS (SELECT concat(CAST(p_size AS STRING), '.') AS code, count(*) AS n FROM part GROUP BY p_size UNION ALL SELECT concat(CAST(p_size AS STRING), '.', CAST(p_partkey AS STRING), '.'), p_partkey % 30 FROM part)
SELECT code, n < 10 AS is_stub, EXISTS (SELECT 1 FROM s t WHERE t.code <> s.code AND starts_with(t.code, s.code)) AS has_children, n < 10 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.code <> s.code AND starts_with(t.code, s.code)) AS title_is_rule, n % 2 = 1 AS is_future FROM s"""
)
def section_tree(spark, sf_dir):
    """Chapters with sections below them and sections without: stubs that point on, and stubs that are rules."""
    p = _part(spark, sf_dir)
    s = p.groupBy(F.concat(F.col("p_size").cast("string"), F.lit(".")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    s = s.union(p.select(F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.lit("")).alias("code"), F.col("p_partkey") % 30))
    sections = s.select("code", F.when(F.col("n") % 2 == 1, "2030-01-01").otherwise("2020-01-01").alias("effective"))
    texts = s.select("code", F.repeat(F.lit("字"), F.col("n").cast("int")).alias("text"))
    return clauses.section_states(sections, texts, "2024-01-01")


_SENTENCES = ["concat(p_name, '。')", "'共同的一句；'", "concat(p_type, '：')", "concat(p_brand, '！')", "'最後一句'"]


@query(
    """SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 5 END AS INTEGER) AS sent_added, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS sent_removed, CAST(CASE p_partkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS INTEGER) AS sent_equal,
round_even(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 / 10.0 WHEN 2 THEN 2 / 10.0 WHEN 3 THEN 3 / 12.0 ELSE 5 / 10.0 END, 4)::DOUBLE AS change_ratio, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'replace:' || p_type || '：>改寫：' WHEN 2 THEN 'delete:' || p_name || '。>;delete:最後一句>' WHEN 3 THEN 'insert:>新一。;replace:' || p_brand || '！>新二！' ELSE 'insert:>' || p_name || '。|共同的一句；|' || p_type || '：|' || p_brand || '！|最後一句' END AS hunks FROM part"""
)
def sentence_hunks(spark, sf_dir):
    """What changed between two texts, sentence by sentence: nothing, a sentence replaced, two that went, one put in and one replaced, and all of it."""
    old = [*_SENTENCES]
    new = {0: old, 1: [*old[:2], "'改寫：'", *old[3:]], 2: [*old[1:4]], 3: [old[0], "'新一。'", *old[1:3], "'新二！'", old[4]], 4: old}
    whole = lambda parts: f"concat({', '.join(parts)})"
    texts = _part(spark, sf_dir).selectExpr("p_partkey", f"CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE {whole(old)} END AS old", f"{_case([whole(new[i]) for i in range(5)])} AS new")
    d = texts.select("p_partkey", diffing.sentence_diff("old", "new").alias("d"))
    hunks = F.transform("d.hunks", lambda h: F.concat(h["op"], F.lit(":"), F.array_join(h["removed"], "|"), F.lit(">"), F.array_join(h["added"], "|")))
    return d.select("p_partkey", "d.sent_added", "d.sent_removed", "d.sent_equal", "d.change_ratio", F.array_join(hunks, ";").alias("hunks"))
