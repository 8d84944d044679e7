"""Queries on dated rows: orders stand for validity rows of a customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, dates
from ..operators import aggregates, temporal
from ..streaming import manifest
from .registry import query, table

AS_OF = "1996-06-30"


def validity_rows(spark, sf_dir):
    """Each order holds for its customer from its day to the day before the next one's; the last has no end."""
    o = table(spark, sf_dir, "orders").withColumn("start", F.date_format("o_orderdate", "yyyy-MM-dd"))
    w = Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")
    return o.withColumn("nxt", F.lead("start").over(w)).withColumn("end", F.date_format(F.date_sub(F.to_date("nxt"), 1), "yyyy-MM-dd"))


_ROWS = "v AS (SELECT *, strftime(CAST(lead(start) OVER (PARTITION BY o_custkey ORDER BY start, o_orderkey) AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS \"end\" FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS start FROM orders))"
_COVERS = f"start <= '{AS_OF}' AND (\"end\" IS NULL OR \"end\" >= '{AS_OF}')"
_STATUS = f"""{_ROWS},
k AS (SELECT o_custkey, max(CASE WHEN {_COVERS} THEN (start, o_orderkey) END) AS cur, min(CASE WHEN start > '{AS_OF}' THEN (start, o_orderkey) END) AS up, max((start, o_orderkey)) AS last, count(*) AS n FROM v GROUP BY o_custkey),
s AS (SELECT o_custkey, n, CASE WHEN cur IS NOT NULL THEN 'active' WHEN up IS NOT NULL THEN 'upcoming' ELSE 'delisted' END AS status, cur, up, CASE WHEN cur IS NOT NULL THEN cur WHEN up IS NULL THEN last END AS shown FROM k)"""


def _resolved(spark, sf_dir):
    rows = validity_rows(spark, sf_dir)
    return temporal.resolve_status(rows, "o_custkey", "start", "end", "o_orderkey", AS_OF, ["o_orderkey", "o_totalprice"])


@query(f"WITH {_STATUS} SELECT o_custkey, status, v.o_orderkey AS current_order, v.start AS valid_from, v.\"end\" AS valid_to, v.o_totalprice AS price FROM s LEFT JOIN v USING (o_custkey) WHERE v.o_orderkey = s.shown[2] OR (s.shown IS NULL AND v.o_orderkey = s.up[2] AND FALSE) UNION ALL SELECT o_custkey, status, NULL, NULL, NULL, NULL FROM s WHERE shown IS NULL")
def current_status(spark, sf_dir):
    return _resolved(spark, sf_dir).select("o_custkey", "status", F.col("current.o_orderkey").alias("current_order"), F.col("current.start").alias("valid_from"), F.col("current.end").alias("valid_to"), F.col("current.o_totalprice").alias("price"))


@query(f"WITH {_STATUS} SELECT o_custkey, v.start AS valid_from, v.o_totalprice AS price FROM s JOIN v USING (o_custkey) WHERE s.cur IS NULL OR v.o_orderkey <> s.cur[2]")
def price_history(spark, sf_dir):
    past = temporal.past_rows(validity_rows(spark, sf_dir), "o_custkey", "start", "end", "o_orderkey", AS_OF)
    return past.select("o_custkey", F.col("start").alias("valid_from"), F.col("o_totalprice").alias("price"))


@query(f"WITH {_STATUS} SELECT o_custkey, up[2] AS next_order, up[1] AS next_from FROM s WHERE up IS NOT NULL")
def upcoming_rows(spark, sf_dir):
    return _resolved(spark, sf_dir).where("upcoming is not null").select("o_custkey", F.col("upcoming.o_orderkey").alias("next_order"), F.col("upcoming.start").alias("next_from"))


@query(
    f"""WITH {_STATUS},
c AS (SELECT n_name, c_mktsegment, c_custkey, nullif(v.o_totalprice, 0) AS price FROM s JOIN v ON v.o_orderkey = s.cur[2] JOIN customer ON c_custkey = s.o_custkey JOIN nation ON n_nationkey = c_nationkey),
g AS (SELECT n_name, c_mktsegment, max(price) AS top FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY top DESC, c_mktsegment) AS rk FROM g)
SELECT n_name, count(*) AS customers, min(price) AS price_min, max(price) AS price_max, (SELECT string_agg(c_mktsegment, ', ' ORDER BY rk) FROM r WHERE r.n_name = c.n_name AND rk <= 3) AS preview FROM c GROUP BY n_name"""
)
def flagship_current_rows(spark, sf_dir):
    """Current row per customer, joined with its nation: price range and the three best segments."""
    cur = _resolved(spark, sf_dir).where("status = 'active'").select("o_custkey", F.col("current.o_totalprice").alias("price"))
    c = cur.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    low, high = aggregates.price_range("price")
    top = c.groupBy("n_name", "c_mktsegment").agg(F.max("price").alias("top"), F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("o"), "c_mktsegment")))
    names = F.transform(F.slice(order, 1, 3), lambda x: x["c_mktsegment"])
    return top.groupBy("n_name").agg(F.sum("n").alias("customers"), F.min("low").alias("price_min"), F.max("high").alias("price_max"), F.array_join(names, ", ").alias("preview"))


@query(
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS from_slash, strftime(d, '%Y-%m-%d') AS from_western, strftime(d, '%Y-%m-%d') AS from_packed, CAST(NULL AS VARCHAR) AS from_forever FROM d"""
)
def roc_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate") - 1911)
    slash = F.format_string("%d/%d/%d", "y", F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    packed = F.format_string("%d%02d%02d", "y", F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return o.select("o_orderkey", dates.roc_to_iso(slash).alias("from_slash"), dates.roc_to_iso(F.date_format("o_orderdate", "yyyyMMdd")).alias("from_western"), dates.roc_to_iso(packed).alias("from_packed"), dates.roc_to_iso(F.lit("9991231")).alias("from_forever"))


@query("SELECT o_custkey, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS revised FROM orders GROUP BY o_custkey")
def revision_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.format_string("%d/%d/%d", F.year("o_orderdate") - 1911, F.month("o_orderdate"), F.dayofmonth("o_orderdate")))
    text = F.concat(F.lit("1.2. Rule（"), F.array_join(F.array_sort(F.collect_list("d")), "、"), F.lit("）(not 85/1/1 a date)"))
    return o.groupBy("o_custkey").agg(text.alias("text")).select("o_custkey", F.array_join(dates.revision_dates("text"), ",").alias("revised"))


_CODES = "c AS (SELECT DISTINCT concat(r_regionkey + 1, '.') AS code FROM region UNION SELECT concat(n_regionkey + 1, '.', n_nationkey + 1, '.') FROM nation UNION SELECT concat(n_regionkey + 1, '.', n_nationkey + 1, '.', c_custkey % 13 + 1, '.') FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def rule_codes(spark, sf_dir):
    """Dotted codes region.nation.group., without repeats."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    code = lambda *x: F.concat(F.concat_ws(".", *(v.cast("string") for v in x)), F.lit("."))
    a = r.select(code(F.col("r_regionkey") + 1).alias("code"))
    b = n.select(code(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1).alias("code"))
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(code(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1, F.col("c_custkey") % 13 + 1).alias("code"))
    return a.union(b).union(d).distinct()


@query(f"WITH {_CODES} SELECT code, row_number() OVER (ORDER BY [CAST(x AS INTEGER) FOR x IN string_split(rtrim(code, '.'), '.')]) AS position, CAST(string_split(code, '.')[1] AS INTEGER) AS chapter, replace(rtrim(code, '.'), '.', '-') AS slug FROM c")
def code_natural_sort(spark, sf_dir):
    c = rule_codes(spark, sf_dir)
    # codes are few, one per rule section, so one window over all of them is fine
    position = F.row_number().over(Window.orderBy(codes.code_tuple("code"))).cast("bigint")
    return c.select("code", position.alias("position"), codes.chapter_no("code").alias("chapter"), codes.slug("code").alias("slug"))


@query(f"WITH {_CODES} SELECT code, CASE WHEN len(string_split(rtrim(code, '.'), '.')) > 1 THEN regexp_replace(code, '[^.]+\\.$', '') END AS parent FROM c")
def code_parent(spark, sf_dir):
    return rule_codes(spark, sf_dir).select("code", codes.parent_code("code").alias("parent"))


@query(f"WITH {_CODES} SELECT a.code, EXISTS (SELECT 1 FROM c b WHERE b.code <> a.code AND starts_with(b.code, a.code)) AS has_children FROM c a")
def code_children(spark, sf_dir):
    from ..operators import clauses

    return clauses.has_children(rule_codes(spark, sf_dir), "code")


_TAGS = "t AS (SELECT * FROM (VALUES ('1.', 'wide'), ('1.6.', 'narrow'), ('2.2.1.', 'leaf'), ('3.1', 'loose')) x(prefix, tag))"


@query(f"WITH {_CODES}, {_TAGS} SELECT code, tag FROM c JOIN t ON starts_with(code, rtrim(prefix, '.') || '.')")
def code_prefix_tags(spark, sf_dir):
    """Prefix join as an equi-join on ancestors."""
    tags = spark.createDataFrame([("1.", "wide"), ("1.6.", "narrow"), ("2.2.1.", "leaf"), ("3.1", "loose")], "prefix string, tag string")
    c = rule_codes(spark, sf_dir).withColumn("above", F.explode(codes.ancestors("code")))
    return c.join(tags.withColumn("above", codes.normalize_code("prefix")), "above").select("code", "tag")


@query("SELECT l_orderkey, '9.' || l_linenumber || '.' AS section, strftime(max(l_shipdate), '%Y-%m-%d') AS effective FROM lineitem GROUP BY l_orderkey, l_linenumber")
def url_latest_seq(spark, sf_dir):
    """The newest file of each section from comma-separated file names."""
    from ..sources import readers

    l = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("9."), F.col("l_linenumber"), F.lit("._"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_001.pdf"))
    older = F.concat(F.lit("9."), F.col("l_linenumber"), F.lit("._19000101.pdf,broken_name.pdf"))
    rows = l.select("l_orderkey", "l_linenumber", F.concat_ws(",", name, older).alias("files"))
    best = rows.groupBy("l_orderkey").agg(F.array_join(F.collect_set("files"), ",").alias("files"))
    return best.select("l_orderkey", F.explode(readers.newest_of("files")).alias("x")).select("l_orderkey", F.col("x.code").alias("section"), "x.effective")


@query("SELECT o_orderkey, c_custkey, (SELECT max(p.o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey AND p.o_orderstatus = 'F' AND p.o_orderdate <= o.o_orderdate) AS last_closed FROM orders o JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'")
def as_of_join(spark, sf_dir):
    """The last closed order of the customer before each open one."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    left = o.where("o_orderstatus = 'O'").select("o_orderkey", "c_custkey", "o_orderdate")
    right = o.where("o_orderstatus = 'F'").select("c_custkey", "o_orderdate", F.col("o_orderdate").alias("last_closed"))
    return temporal.as_of_join(left, right, "c_custkey", "o_orderdate", "o_orderdate", ["last_closed"]).select("o_orderkey", "c_custkey", "last_closed")


_MANIFESTS = """o AS (SELECT doc_id AS code, 'f' || doc_id % 5 AS file, '2020-01-01' AS effective, md5(text) AS sha FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id AS code, CASE WHEN doc_id % 11 = 0 THEN 'g' ELSE 'f' END || doc_id % 5 AS file, CASE WHEN doc_id % 13 = 0 THEN '2019-01-01' ELSE '2020-02-01' END AS effective, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END AS sha, doc_id % 17 = 0 AS failed FROM documents WHERE doc_id % 19 <> 0)"""


@query(
    f"""WITH {_MANIFESTS}
SELECT coalesce(o.code, n.code) AS code, CASE WHEN coalesce(n.failed, FALSE) THEN CASE WHEN o.sha IS NOT NULL THEN 'fetch_stale' ELSE 'fetch_failed' END WHEN n.file IS NULL THEN 'gone' WHEN o.file IS NULL THEN 'new' WHEN n.effective < o.effective THEN 'unchanged' WHEN o.file <> n.file THEN 'revised' WHEN o.sha <> n.sha THEN 'silent_edit' ELSE 'unchanged' END AS kind,
CASE WHEN coalesce(n.failed, FALSE) OR n.file IS NULL THEN o.file WHEN o.file IS NULL THEN n.file WHEN n.effective < o.effective THEN o.file ELSE n.file END AS file
FROM o FULL JOIN n ON o.code = n.code"""
)
def change_events(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sha, i = F.md5(F.col("text").cast("binary")), F.col("doc_id")
    old = d.where(i % 7 != 0).select(i.alias("code"), F.concat(F.lit("f"), i % 5).alias("file"), F.lit("2020-01-01").alias("effective"), sha.alias("sha"), F.lit("2020-01-01").alias("first_seen"), F.lit(None).cast("string").alias("prev_file"))
    new = d.where(i % 19 != 0).select(
        i.alias("code"), F.concat(F.when(i % 11 == 0, "g").otherwise("f"), i % 5).alias("file"), F.when(i % 13 == 0, "2019-01-01").otherwise("2020-02-01").alias("effective"),
        F.when(i % 3 == 0, F.md5(F.concat("text", F.lit("!")).cast("binary"))).otherwise(sha).alias("sha"), F.lit("2020-02-01").alias("seen"), (i % 17 == 0).alias("failed"),
    )
    return temporal.compare_manifests(old, new).select("code", "kind", "file")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    out = manifest.event_windows(table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS INTEGER) AS age_days, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') > 45 AS stale, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') / 365.25) AS INTEGER) AS years, strftime(o_orderdate, '%Y-%m-%d') <= '1996-06-30' AS in_force FROM orders")
def staleness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    end = F.lit("1998-12-31")
    return o.select("o_orderkey", dates.days_between(end, "d").alias("age_days"), dates.is_stale("d", end).alias("stale"), dates.full_years(end, "d").alias("years"), dates.in_force("d", F.lit(AS_OF)).alias("in_force"))


@query(
    """WITH b AS (SELECT p_partkey AS code, 'a' || p_partkey % 4 AS file, '2020-01-0' || p_partkey % 9 + 1 AS effective FROM part),
l AS (SELECT p_partkey AS code, 'a' || p_partkey % 3 AS file, '2020-01-0' || p_partkey % 5 + 1 AS effective FROM part WHERE p_partkey % 2 = 0)
SELECT code, CASE WHEN l.file <> b.file AND l.effective >= b.effective THEN l.file ELSE b.file END AS file, CASE WHEN l.file <> b.file AND l.effective >= b.effective THEN l.effective ELSE b.effective END AS effective, coalesce(l.file <> b.file AND l.effective >= b.effective, FALSE) AS replaced FROM b LEFT JOIN l USING (code)"""
)
def live_overlay(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"))
    made = lambda df, a, b: df.select("code", F.concat(F.lit("a"), F.col("code") % a).alias("file"), F.concat(F.lit("2020-01-0"), F.col("code") % b + 1).alias("effective"))
    return temporal.overlay_newest(made(p, 4, 9), made(p.where("code % 2 = 0"), 3, 5))


@query(
    """SELECT o_orderkey, 4 AS n_pieces, strftime(o_orderdate, '%Y-%m-%d') AS first_iso, CAST(year(o_orderdate) - 1911 AS VARCHAR) || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS first_text, '1997-09-01' AS last_iso FROM orders"""
)
def date_annotations(spark, sf_dir):
    """A rule's date list, cut into dates and what is between them."""
    day = F.format_string("%d/%d/%d", F.year("o_orderdate") - 1911, F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    pieces = F.filter(dates.annotate_dates(F.concat(F.lit("since "), day, F.lit("、"), F.lit("86/9/1"))), lambda p: p["text"] != "")
    out = table(spark, sf_dir, "orders").select("o_orderkey", pieces.alias("p"))
    return out.select("o_orderkey", F.size("p").alias("n_pieces"), F.get("p", F.lit(1))["iso"].alias("first_iso"), F.get("p", F.lit(1))["text"].alias("first_text"), F.get("p", F.lit(3))["iso"].alias("last_iso"))
