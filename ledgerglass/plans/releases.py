"""Queries on releases, what changed between them, views of chapters, covers, locale order and the manifest as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import change_tree, cover, details, gates, search
from ..sources import publish, readers, releases, scratch
from ..streaming import watch
from .registry import query, table


def _folder(spark, name: str) -> str:
    return f"{scratch.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS early FROM orders), c AS (SELECT count(*) AS n FROM customer),
r AS (SELECT 1 AS number, 'orders' AS "table", early AS n_rows FROM o UNION ALL SELECT 1, 'customer', n FROM c UNION ALL SELECT 2, 'orders', n FROM o UNION ALL SELECT 2, 'customer', n FROM c UNION ALL SELECT 3, 'orders', early FROM o UNION ALL SELECT 3, 'customer', n FROM c)
SELECT CAST(number AS BIGINT) AS number, "table", n_rows, n_rows - lag(n_rows) OVER (PARTITION BY "table" ORDER BY number) AS change, CASE WHEN number = 2 THEN '901' ELSE '' END AS overridden FROM r"""
)
def release_history(spark, sf_dir):
    """Orders of before 1998, then all of them against the drift gate and by an override, then back again; what the gate stopped is not there."""
    root = _folder(spark, "releases")
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    releases.publish(spark, root, {"customer": customer, "orders": orders.where("o_orderdate < TIMESTAMP '1998-01-01'")}, [gates.unique(1, "keys", "orders", "o_orderkey")])
    rules = releases.drift_gates(spark, root)
    try:
        releases.publish(spark, root, {"customer": customer, "orders": orders}, rules)
    except publish.GateFailure:
        releases.publish(spark, root, {"customer": customer, "orders": orders}, rules, override=(901,))
    releases.rollback(spark, root, 1)
    return releases.history(spark, root).select("number", "table", "n_rows", "change", F.array_join(F.col("overridden").cast("array<string>"), ",").alias("overridden"))


#: What the next release changes: in one stretch of keys prices, statuses, and orders that go; some that come.
_REVISED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey BETWEEN 300 AND 900 AND o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey BETWEEN 300 AND 900 AND o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE NOT (o_orderkey BETWEEN 300 AND 900 AND o_orderkey % 11 = 0)
UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 1000 = 1"""


@query(
    f"""WITH n AS ({_REVISED})
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_totalprice <> n.o_totalprice THEN 'o_totalprice' END], lambda x: x IS NOT NULL), ',') END AS columns
FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus OR o.o_totalprice <> n.o_totalprice"""
)
def changed_orders(spark, sf_dir):
    """Which orders a release changes, and what in them; ranges of keys in which nothing changed are not read."""
    old = table(spark, sf_dir, "orders")
    new = spark.sql(_REVISED.replace("FROM orders", "FROM {orders}"), orders=old)
    cuts = change_tree.ranges(old, "o_orderkey", 64)
    before, after = _folder(spark, "orders-before"), _folder(spark, "orders-after")
    change_tree.store(old, "o_orderkey", before, cuts)
    change_tree.store(new, "o_orderkey", after, cuts)
    return change_tree.changes(spark, before, after, "o_orderkey").select("o_orderkey", "kind", F.array_join("columns", ",").alias("columns"))


_SECTION = "concat(CAST(p_size AS STRING), '.', CAST(p_partkey AS STRING), '.')"


@query(
    f"""WITH s AS (SELECT {_SECTION} AS code, p_size AS chapter, p_name AS title, p_partkey FROM part), w AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount >= 0.1 AND l_tax = 0),
n AS (SELECT l_partkey, string_agg(strftime(l_shipdate, '%Y-%m-%d') || ' ' || l_returnflag, ';' ORDER BY strftime(l_shipdate, '%Y-%m-%d'), l_returnflag) AS pending FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY l_partkey)
SELECT code, CAST(chapter AS INTEGER) AS chapter, title, coalesce(pending, '') AS pending FROM s JOIN w ON w.l_partkey = p_partkey LEFT JOIN n ON n.l_partkey = p_partkey WHERE chapter BETWEEN 3 AND 9"""
)
def chapter_details(spark, sf_dir):
    """Sections of seven chapters, those of parts sold at the largest discount, with notices of what is shipped late; the other chapters are not read."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    coded = part.selectExpr(f"{_SECTION} AS code", "p_name AS title", "p_partkey", "p_size")
    path = _folder(spark, "chapters")
    publish.write_chapters(coded.select("code", "title"), "code", path)
    sold = lines.where("l_discount >= 0.1 AND l_tax = 0").select(F.col("l_partkey").alias("p_partkey"))
    wanted = coded.where("p_size BETWEEN 3 AND 9").join(sold, "p_partkey", "left_semi").select("code")
    late = lines.where("l_shipdate >= TIMESTAMP '1998-06-01'").join(coded, F.col("l_partkey") == F.col("p_partkey"))
    pending = late.select("code", F.date_format("l_shipdate", "yyyy-MM-dd").alias("announced"), F.col("l_returnflag").alias("notice"))
    out = details.detail_view(spark, path, wanted, "code", pending)
    return out.select("code", "chapter", "title", F.array_join(F.transform("pending", lambda x: F.concat_ws(" ", x["announced"], x["notice"])), ";").alias("pending"))


@query(
    """WITH RECURSIVE s AS (SELECT o_custkey AS name, list(DISTINCT date_trunc('week', o_orderdate)) AS weeks FROM orders GROUP BY 1),
a AS (SELECT list({'name': name, 'weeks': weeks} ORDER BY name) AS sets, list_distinct(flatten(list(weeks))) AS everything FROM s),
g AS (SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS name, CAST(0 AS BIGINT) AS gain, everything AS missing FROM a
UNION ALL SELECT place + 1, best.name, CAST(len(list_intersect(best.weeks, missing)) AS BIGINT), list_filter(missing, lambda x: NOT list_contains(best.weeks, x))
FROM (SELECT place, missing, list_reduce(sets, lambda p, q: CASE WHEN len(list_intersect(q.weeks, missing)) > len(list_intersect(p.weeks, missing)) THEN q ELSE p END) AS best FROM g, a WHERE len(missing) > 0))
SELECT place, name, gain FROM g WHERE place > 0"""
)
def lazy_cover(spark, sf_dir):
    """Customers who together have an order in every week in which anybody has, greedily."""
    return cover.lazy_cover(table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("week", "o_orderdate").alias("week")), "o_custkey", "week")


_SPELT = "CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN lower(c_name) WHEN 3 THEN replace(c_name, 'Customer', 'Çustomer') WHEN 4 THEN replace(c_name, '#', 'é ') ELSE replace(c_name, 'u', 'ü') END"


@query(f"WITH c AS (SELECT c_mktsegment, c_custkey, {_SPELT} AS name FROM customer) SELECT c_mktsegment, c_custkey, name, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY name COLLATE en, c_custkey) AS INTEGER) AS place FROM c")
def locale_order(spark, sf_dir):
    """Names of each segment in the order of their language: letters before case and accents, where code points would put capitals first."""
    c = table(spark, sf_dir, "customer").selectExpr("c_mktsegment", "c_custkey", f"{_SPELT} AS name")
    w = F.row_number().over(search.by_locale("name", "c_custkey", partition="c_mktsegment"))
    return c.select("c_mktsegment", "c_custkey", "name", w.alias("place"))


_FETCHES = "SELECT CAST(o_custkey AS STRING) AS code, concat('f', substr(CAST(o_orderdate AS STRING), 1, 7)) AS file, substr(CAST(o_orderdate AS STRING), 1, 7) AS effective, CAST(CAST(floor(o_totalprice / 200000) AS INT) AS STRING) AS sha, substr(CAST(o_orderdate AS STRING), 1, 10) AS seen, o_orderkey AS ordinal, FALSE AS failed, CAST(o_orderdate AS TIMESTAMP) AS looked FROM orders"


@query(
    f"""WITH f AS ({_FETCHES}), x AS (SELECT *, lag(file) OVER w AS old_file, lag(sha) OVER w AS old_sha FROM f WINDOW w AS (PARTITION BY code ORDER BY looked, ordinal)),
e AS (SELECT code, CASE WHEN old_file IS NULL THEN 'new' WHEN file <> old_file THEN 'revised' WHEN sha <> old_sha THEN 'silent_edit' END AS kind, file FROM x),
l AS (SELECT code, max(looked) AS last, max_by(file, (looked, ordinal)) AS file FROM f GROUP BY code), t AS (SELECT max(looked) AS now FROM f)
SELECT code, kind, file, count(*) AS n FROM (SELECT code, kind, file FROM e WHERE kind IS NOT NULL UNION ALL SELECT code, 'stale', file FROM l, t WHERE last + INTERVAL 90 DAY <= now) GROUP BY ALL"""
)
def manifest_watch(spark, sf_dir):
    """Orders as fetches of a customer's file, as a stream: what happened to each, and which have not been looked at for 90 days when the stream ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watch.PROVIDER)
    source, out, checkpoint = (_folder(spark, f"watch-{x}") for x in ("in", "out", "checkpoint"))
    fetches = spark.sql(_FETCHES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")).withColumnRenamed("looked", "at")
    fetches.write.parquet(source)
    stream = watch.manifest_watch(spark.readStream.schema(fetches.schema).parquet(source), 90)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(watch.OUT).parquet(out).groupBy("code", "kind", "file").agg(F.count(F.lit(1)).alias("n"))


#: Rows of a master file; a file whose fields have line breaks is read by one task.
_MASTER_ROWS = 20_000
_MASTER = """SELECT concat('P', CAST(p_partkey AS STRING)) AS a, CAST(p_size AS STRING) AS b, '1150601' AS c, '' AS d, concat('"', p_name, '", ', p_type) AS e, concat('處置', CAST(p_size AS STRING), chr(10), p_brand) AS f, CASE WHEN p_partkey % 3 = 0 THEN concat(repeat(p_name, 500), '。') END AS g FROM part"""


@query(f"SELECT a AS code, CAST(b AS INTEGER) AS points, '2026-06-01' AS valid_from, CAST(NULL AS VARCHAR) AS valid_to, e AS name_en, f AS name, md5(coalesce(g, '')) AS note FROM ({_MASTER})")
def master_csv(spark, sf_dir):
    """Parts written as master files of bounded size and read back by their contract: quotes, commas and line breaks in fields, and notes of thousands of characters."""
    path = _folder(spark, "master")
    part = table(spark, sf_dir, "part")
    part = part.repartition(1 + part.count() // _MASTER_ROWS, "p_partkey")  # equal shares, written side by side
    spark.sql(_MASTER.replace("FROM part", "FROM {part}"), part=part).toDF(*readers.PROCEDURE_COLUMNS).write.csv(path, header=True, escape='"', quoteAll=True, nullValue="")
    code, points, begin, end, name_en, name, note = (F.col(c) for c in readers.PROCEDURE_COLUMNS)
    rows = readers.csv_master(spark, path, readers.PROCEDURE_COLUMNS)
    return rows.select(code.alias("code"), points.cast("int").alias("points"), dates.roc_to_iso(begin).alias("valid_from"), dates.roc_to_iso(end).alias("valid_to"), name_en.alias("name_en"), name.alias("name"), F.md5(F.coalesce(note, F.lit("")).cast("binary")).alias("note"))


@query("SELECT s_suppkey, s_name, [CAST(s_nationkey AS VARCHAR), s_name][1] AS first, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier")
def json_arrays(spark, sf_dir):
    """Suppliers as arrays of objects, a file for each nation, read back as rows."""
    path = _folder(spark, "arrays")
    s = table(spark, sf_dir, "supplier").withColumn("tags", F.array(F.col("s_nationkey").cast("string"), "s_name"))
    arrays = s.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "tags", "s_acctbal"))).alias("value"))
    arrays.repartition(32, "s_nationkey").select("s_nationkey", "value").write.partitionBy("s_nationkey").text(path)
    rows = readers.json_array(spark, path, "s_suppkey bigint, s_name string, tags array<string>, s_acctbal double")
    return rows.select("s_suppkey", "s_name", F.get("tags", 0).alias("first"), F.col("s_acctbal").alias("balance"))
