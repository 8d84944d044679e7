"""Queries on products, licences and ingredients: parts, orders and lines stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, routes
from ..operators import aggregates, cover, gates, licence, tables
from ..sources import publish
from .registry import query, table

#: Words of part types that stand for salts and esters.
VOCABULARY = names.Vocabulary(
    preserve=frozenset({"LARGE", "SMALL"}),
    salts=frozenset({"STEEL", "TIN"}),
    esters=frozenset({"BRASS", "COPPER"}),
    ester_alias={"NICKEL": "COPPER"},
    aliases={"PROMO": "PROMOTION"},
    base_atc_ester={"SMALL|ABCD": "BRASS"},
)


@query(
    """WITH p AS (SELECT p_partkey, upper(p_type) AS t FROM part),
s AS (SELECT p_partkey, string_split(t, ' ') AS w FROM p),
x AS (SELECT p_partkey, w[1] AS base, CASE w[2] WHEN 'NICKEL' THEN 'COPPER' ELSE w[2] END AS tail FROM s)
SELECT p_partkey, CASE WHEN tail IN ('BRASS', 'COPPER') AND base IN ('LARGE', 'SMALL') THEN base || ' (' || tail || ')'
  WHEN base = 'PROMO' AND (tail IS NULL OR tail IN ('BRASS', 'COPPER', 'STEEL', 'TIN')) THEN 'PROMOTION'
  WHEN tail IS NULL OR tail IN ('BRASS', 'COPPER', 'STEEL', 'TIN') THEN base ELSE base || ' ' || tail END AS inn FROM x"""
)
def name_canonical(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat_ws(" ", "p_type", F.concat(F.col("p_size"), F.lit("MG/ML")))
    return p.select("p_partkey", names.canonicalize(raw, VOCABULARY).alias("inn"))


@query("SELECT p_partkey, p_type || '|' || p_brand || ' (A+B)|' || p_size AS parts, CAST(3 AS INTEGER) AS n FROM part")
def split_components(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat("p_type", F.lit(" + "), "p_brand", F.lit(" (A+B) +"), "p_size")
    parts = names.split_components(text)
    return p.select("p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS' THEN 'INJ' WHEN p_type LIKE '%SMALL%' THEN 'OPH' WHEN p_type LIKE '%STEEL%' THEN 'PO' WHEN p_type LIKE '%A%' THEN 'TOP' ELSE 'OTHER' END AS route, CASE WHEN p_type LIKE '%BRASS' THEN 'group' WHEN p_type LIKE '%SMALL%' OR p_type LIKE '%STEEL%' OR p_type LIKE '%A%' THEN 'keyword' ELSE 'unknown' END AS source FROM part")
def route_classify(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    group = F.element_at(F.split("p_type", " "), -1)
    got = routes.derive(group, "p_type", {"INJ": ["BRASS"]}, [("OPH", ["SMALL"]), ("PO", ["STEEL"]), ("TOP", ["A"])], ["乳劑"])
    return p.select("p_partkey", got.alias("x")).select("p_partkey", "x.*")


def _licences(spark, sf_dir):
    """An order is a licence; urgent ones are cancelled. Equal numbers come twice."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 5000).alias("no"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("").alias("cancelled"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("indication"))


_LICENCES = "l AS (SELECT o_orderkey % 5000 AS no, CASE WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE '' END AS cancelled, o_orderkey AS ordinal, o_orderpriority AS indication FROM orders), d AS (SELECT no, arg_min((cancelled, ordinal, indication), (CAST(cancelled <> '' AS INTEGER), ordinal)) AS x FROM l GROUP BY no)"


@query(f"WITH {_LICENCES} SELECT no, x[1] AS cancelled, x[2] AS ordinal, x[3] AS indication FROM d")
def licence_dedupe(spark, sf_dir):
    return licence.prefer_active(_licences(spark, sf_dir), ["no"], "cancelled", "ordinal", ["cancelled", "ordinal", "indication"])


@query(f"WITH {_LICENCES} SELECT l_linestatus, CASE WHEN d.no IS NULL THEN 'miss' WHEN x[1] = '' THEN 'active' ELSE 'stale' END AS licence_state, count(*) AS n FROM lineitem LEFT JOIN d ON d.no = l_orderkey % 7000 GROUP BY ALL")
def licence_tier(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_orderkey") % 7000).alias("no"))
    found = licence.prefer_active(_licences(spark, sf_dir), ["no"], "cancelled", "ordinal", ["cancelled"])
    return licence.tiered_join(lines, found, ["no"], "cancelled").groupBy("l_linestatus", "licence_state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_insert FROM orders")
def insert_flag(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return licence.with_flag(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", members, "has_insert")


@query("SELECT p_partkey, '衛署藥製字' AS series, CAST(p_partkey AS VARCHAR) AS serial, CAST(NULL AS VARCHAR) AS bad FROM part")
def licence_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://example.org/q?licId=01"), F.lpad(F.col("p_partkey").cast("string"), F.greatest(F.length(F.col("p_partkey").cast("string")), F.lit(6)), "0"), F.lit("&x=1"))
    key = licence.id_to_key(licence.id_from_url(url))
    return p.select("p_partkey", key["series"].alias("series"), key["serial"].alias("serial"), licence.id_to_key(F.lit("99abc"))["serial"].alias("bad"))


@query("SELECT o_custkey, bool_or(l_discount > 0.09) AS prior_review, bool_or(l_tax > 0.07) AS special_case, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS specialists FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def flag_or_rollup(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_discount") > 0.09).alias("prior_review"), (F.col("l_tax") > 0.07).alias("special_case"), F.array("l_returnflag").alias("specialists"))
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(l, "o_orderkey")
    return aggregates.set_flags(j, ["o_custkey"], ["prior_review", "special_case"], ["specialists"]).withColumn("specialists", F.array_join("specialists", ","))


@query("WITH t AS (SELECT * FROM (VALUES ('Brand#1', 'one'), ('Brand#12', 'twelve'), ('Brand#3', 'three')) x(prefix, tag)) SELECT p_partkey, prefix, tag FROM part JOIN t ON starts_with(p_brand, prefix)")
def atc_block_tags(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    tags = spark.createDataFrame([("Brand#1", "one"), ("Brand#12", "twelve"), ("Brand#3", "three")], "prefix string, tag string")
    return aggregates.prefix_tags(p, "p_brand", tags, "prefix", [7, 8]).select("p_partkey", "prefix", "tag")


@query(
    """WITH x AS (SELECT l_suppkey, p_brand, p_size > 25 AS originator, l_extendedprice AS price, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT l_suppkey, p_brand, arg_min((originator, price, ordinal), ordinal) AS v FROM x GROUP BY ALL),
h AS (SELECT *, bool_or(v[1]) OVER (PARTITION BY l_suppkey) AS has FROM f),
r AS (SELECT l_suppkey, p_brand, v[2] AS price, row_number() OVER (PARTITION BY l_suppkey ORDER BY v[2] DESC, v[3]) AS rank FROM h WHERE v[1] OR NOT has)
SELECT l_suppkey, p_brand, price, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def brand_preview_top3(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = l.select("l_suppkey", "p_brand", (F.col("p_size") > 25).alias("originator"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return aggregates.brand_preview(rows, ["l_suppkey"], "p_brand", "originator", "price", "ordinal").select("l_suppkey", "p_brand", "price", "rank")


@query("SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL HAVING count(*) >= 2")
def vote_threshold(spark, sf_dir):
    return aggregates.votes(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT l_suppkey, l_returnflag, min(nullif(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice END, 0)) AS price_min, max(nullif(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice END, 0)) AS price_max FROM lineitem GROUP BY ALL")
def price_range(spark, sf_dir):
    low, high = aggregates.price_range(F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(low.alias("price_min"), high.alias("price_max"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'unlisted' ELSE '$' || regexp_replace(format('{:,.2f}', p_retailprice), '\\.?0+$', '') END AS shown FROM part")
def money(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", publish.money(F.when(F.col("p_partkey") % 10 == 0, 0.0).otherwise(F.col("p_retailprice"))).alias("shown"))


@query(
    """WITH x AS (SELECT p_brand AS inn, p_size % 4 AS route, l_linestatus AS section, p_partkey AS code, nullif(l_extendedprice, 0) AS price FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT inn, CAST(route AS VARCHAR) AS route, count(DISTINCT code) AS n_products, string_agg(DISTINCT section, ',' ORDER BY section) AS sections, min(price) AS price_min, max(price) AS price_max FROM x GROUP BY ALL"""
)
def ingredient_tree(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = l.select(F.array("p_brand").alias("inn_keys"), (F.col("p_size") % 4).cast("string").alias("route"), F.array("l_linestatus").alias("sections"), F.col("p_partkey").alias("code"), F.col("l_extendedprice").alias("price"), F.col("p_type").alias("brand"))
    tree = aggregates.ingredient_tree(rows)
    return tree.select("inn", F.explode("routes").alias("route", "x")).select("inn", "route", "x.n_products", F.array_join("x.sections", ",").alias("sections"), "x.price_min", "x.price_max")


@query("WITH f AS (SELECT o_orderpriority AS name, count(*) || ':' || sum(CAST('0x' || substr(md5(o_orderkey || '|' || CAST(o_totalprice AS DECIMAL(18,2))), 1, 15) AS BIGINT)) AS content FROM orders GROUP BY o_orderpriority) SELECT substr(sha256(string_agg(name || ':' || sha256(content), '' ORDER BY name || ':' || sha256(content))), 1, 16) AS fingerprint FROM f")
def fingerprint(spark, sf_dir):
    """A file is all orders of a priority, for which a mark of fixed width stands."""
    mark = aggregates.content_mark(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    files = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(mark.alias("content"))
    return aggregates.fingerprint(files, "o_orderpriority", "content")


@query(
    """WITH RECURSIVE s AS (SELECT format('{:06d}', l_suppkey) AS supplier, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
a AS (SELECT list({'supplier': supplier, 'brands': brands} ORDER BY supplier) AS sets, list_distinct(flatten(list(brands))) AS everything FROM s),
g AS (SELECT -1 AS place, CAST(NULL AS VARCHAR) AS supplier, everything AS missing FROM a
UNION ALL SELECT place + 1, best.supplier, list_filter(missing, lambda x: NOT list_contains(best.brands, x)) FROM (SELECT place, missing, list_reduce(sets, lambda p, q: CASE WHEN len(list_intersect(q.brands, missing)) > len(list_intersect(p.brands, missing)) THEN q ELSE p END) AS best FROM g, a WHERE len(missing) > 0))
SELECT CAST(place AS INTEGER) AS place, supplier FROM g WHERE place >= 0"""
)
def set_cover(spark, sf_dir):
    """Suppliers that together serve all part brands, greedily."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.format_string("%06d", "l_suppkey").alias("supplier"), "p_brand")
    return cover.lazy_cover(l, "supplier", "p_brand").select((F.col("place") - 1).cast("int").alias("place"), F.col("name").alias("supplier"))


@query(
    """SELECT 1 AS id, count(*) >= 5 AS passed FROM nation UNION ALL SELECT 2, count(*) FILTER (WHERE o_totalprice <= 0) = 0 FROM orders
UNION ALL SELECT 3, avg(CAST(l_discount > 0.09 AS DOUBLE)) <= 0.02 FROM lineitem UNION ALL SELECT 4, count(c_custkey) = count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 5, count(DISTINCT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name END) = 2 FROM region UNION ALL SELECT 6, TRUE FROM (SELECT 1)
UNION ALL SELECT 7, count(*) = 0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"""
)
def quality_gates(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("nation", "orders", "lineitem", "customer", "region")}
    t["orphans"] = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    rules = [
        gates.at_least(1, "nations", "nation", 5), gates.none(2, "prices", "orders", F.col("o_totalprice") <= 0), gates.share_at_most(3, "discounts", "lineitem", F.col("l_discount") > 0.09, 0.02),
        gates.unique(4, "customer keys", "customer", "c_custkey"), gates.contains_all(5, "canaries", "region", "r_name", ["ASIA", "EUROPE"]), gates.drift(6, "drift", "nation", None), gates.none(7, "dangling customers", "orphans", F.lit(True)),
    ]
    return gates.run(rules, t).select("id", "passed")


@query(
    """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N') AS f FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, n, (2.0 * n + f) / (3 * n) AS density FROM g)
SELECT l_orderkey, CAST(CASE WHEN n > 0 THEN 3 END AS INTEGER) AS width, round(density, 6) AS density, CAST(NULL AS VARCHAR) AS problem FROM s"""
)
def grid_validate(spark, sf_dir):
    """The lines of an order as a grid of three columns."""
    row = F.array(F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), "l_linestatus")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))), lambda x: x["row"]).alias("grid"))
    return g.select("l_orderkey", tables.grid_score(F.col("grid"))["width"].alias("width"), F.round(tables.grid_score(F.col("grid"))["density"], 6).alias("density"), tables.grid_problem(F.col("grid")).alias("problem"))


@query("SELECT p_partkey, replace(replace(replace(replace(p_type || ' (' || p_brand || '/X)', '/', '_'), ' ', '_'), '(', ''), ')', '') AS shard FROM part")
def shard_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.shard_name(F.concat("p_type", F.lit(" ("), "p_brand", F.lit("/X)"))).alias("shard"))


@query("SELECT p_partkey AS k, p_name AS n, 'd' AS t, substr(repeat(p_name, 40), 1, 600) AS note, length(repeat(p_name, 40)) > 600 AS note_more, CAST(NULL AS VARCHAR) AS ch FROM part UNION ALL SELECT s_suppkey, s_name, 'p', NULL, NULL, 'chapter' FROM supplier")
def slim_union(spark, sf_dir):
    drugs = publish.slim(table(spark, sf_dir, "part").withColumn("long", F.repeat("p_name", 40)), {"p_partkey": "k", "p_name": "n"}, "long")
    procedures = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"), F.lit("chapter").alias("ch"))
    return publish.search_index(drugs, procedures)


_CATALOGUE = """x AS (SELECT l_suppkey AS inn, l_orderkey * 10 + l_linenumber AS ordinal, l_returnflag AS route, CASE WHEN l_linenumber = 2 THEN '+ ' || upper(substr(split_part(p_type, ' ', -1), 1, 1)) || lower(substr(split_part(p_type, ' ', -1), 2)) ELSE '' END AS partners,
 CASE WHEN l_linenumber % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS name, CASE WHEN p_size > 40 THEN split_part(p_type, ' ', 1) END AS zh, p_size > 25 AS originator, l_linenumber <> 1 AS priced, l_linestatus = 'O' AS has_insert FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _catalogue(spark, sf_dir):
    """Lines as products: the supplier is the ingredient, a second line is a combination with the last word of the part's type."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    inn = F.format_string("S%d", "l_suppkey")
    return l.select(
        inn.alias("inn"), F.when(F.col("l_linenumber") == 2, F.array(inn, F.substring_index("p_type", " ", -1))).otherwise(F.array(inn)).alias("inn_keys"), F.col("l_returnflag").alias("route"), F.when(F.col("l_linenumber") % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("brand_en"),
        F.when(F.col("p_size") > 40, F.substring_index("p_type", " ", 1)).alias("brand_zh"), F.lit("unnamed").alias("name_en"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_extendedprice")).alias("price"), (F.col("p_size") > 25).alias("originator"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_linestatus") == "O").alias("has_insert"), "l_suppkey",
    )


@query(
    f"""WITH {_CATALOGUE},
g AS (SELECT inn, route, partners, min(name) AS name, bool_or(originator) AS originator, bool_or(priced) AS priced, count(*) AS n, string_agg(DISTINCT zh, ',' ORDER BY zh) AS zh FROM x GROUP BY inn, route, partners, lower(name))
SELECT 'S' || inn AS inn, route, partners, name, originator, priced, n, coalesce(zh, '') AS zh, CAST(row_number() OVER (PARTITION BY inn, route ORDER BY partners <> '', partners, priced DESC, originator DESC, name) AS INTEGER) AS place FROM g"""
)
def brand_overview(spark, sf_dir):
    return aggregates.brand_overview(_catalogue(spark, sf_dir)).withColumn("zh", F.array_join("zh", ","))


@query(f"WITH {_CATALOGUE} SELECT 'S' || inn AS inn, route, arg_min(ordinal, (CAST(NOT originator AS INTEGER), ordinal)) AS ordinal FROM x WHERE has_insert GROUP BY inn, route")
def representative(spark, sf_dir):
    """The product whose insert stands for an ingredient's route."""
    return aggregates.representative(_catalogue(spark, sf_dir), ["inn", "route"], "has_insert", "originator", "ordinal", ["ordinal"])


@query(f"WITH {_CATALOGUE} SELECT 'route' AS kind, route AS value, count(*) AS n FROM x GROUP BY route UNION ALL SELECT 'originator', CAST(originator AS VARCHAR), count(*) FROM x GROUP BY originator UNION ALL SELECT 'warnings', w, count(*) FROM (SELECT CASE WHEN partners <> '' THEN 'combination' END AS w FROM x UNION ALL SELECT CASE WHEN NOT priced THEN 'unlisted' END FROM x) WHERE w IS NOT NULL GROUP BY w")
def report_counters(spark, sf_dir):
    """Counters of a build: routes, originators, warnings of which a product may have several."""
    warnings = F.array_compact(F.array(F.when(F.size("inn_keys") > 1, "combination"), F.when(F.col("price") == 0, "unlisted")))
    return aggregates.counters(_catalogue(spark, sf_dir).withColumn("warnings", warnings), ["route", "originator"], ["warnings"])
