"""Aggregates of the catalogue: trees, votes, representatives, prefix tags, covers, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def common_texts(rows: DataFrame, group: list[str], text: str, norm: Column, rank: str, ordinal: str, k: int = 4) -> DataFrame:
    """The k most frequent texts of a group by normal form: longest spelling as representative, count, best rank; ties by first seen."""
    g = rows.withColumn("norm", norm).groupBy(*group, "norm").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(text, F.struct(F.length(text), -F.col(ordinal))).alias(text), F.min(rank).alias(rank), F.min(ordinal).alias("first_seen")
    )
    return top_per_group(g, group, [F.desc("n"), F.asc("first_seen")], k)


def votes(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Values that at least `least` rows of a key have."""
    return rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)


def price_range(price) -> tuple[Column, Column]:
    """Least and greatest price; 0 means unlisted and does not count."""
    p = F.nullif(F.col(price) if isinstance(price, str) else price, F.lit(0.0))
    return F.min(p), F.max(p)


def brand_preview(products: DataFrame, group: list[str], brand: str, originator: str, price: str, ordinal: str, k: int = 3) -> DataFrame:
    """Up to k brands of a group: originators by price if there are any, else all others; each brand by its first row."""
    first = products.groupBy(*group, brand).agg(F.min_by(F.struct(originator, price, ordinal), ordinal).alias("x")).select(*group, brand, "x.*")
    has = F.max(F.col(originator).cast("int")).over(Window.partitionBy(*group)) == 1
    kept = first.withColumn("__has", has).where(F.col(originator) | ~F.col("__has")).drop("__has")
    return top_per_group(kept, group, [F.desc_nulls_last(price), F.asc(ordinal)], k)


def set_flags(rows: DataFrame, key: list[str], flags: list[str], lists: list[str]) -> DataFrame:
    """OR of flags and sorted union of list columns."""
    return rows.groupBy(*key).agg(
        *(F.bool_or(F.coalesce(f, F.lit(False))).alias(f) for f in flags),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists),
    )


def prefix_tags(codes: DataFrame, code: str, tags: DataFrame, prefix: str, lengths: list[int], blocked: DataFrame | None = None) -> DataFrame:
    """Tags whose prefix a code starts with. Codes are expanded to their prefixes of the given lengths, which makes it an equi-join; blocked codes go first."""
    c = codes if blocked is None else codes.join(blocked, code, "left_anti")
    cut = F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col(code), F.lit(1), n)))
    return c.withColumn("__p", F.explode(cut)).join(tags.withColumnRenamed(prefix, "__p"), "__p").withColumnRenamed("__p", prefix)


def brand_labels(products: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """products (*group, en, label, originator, price, ordinal) -> *group, rank, label: up to k brands to show.

    Of the originators, if the group has any, else of the others, names in English by
    price, each once under the label of its best-paid row (the first among equals). Where
    none of those has an English name, the first labels of the others in code-point order. Null
    prices are 0, null names and labels empty.
    """
    filled = lambda c: F.coalesce(c, F.lit(""))
    rows = products.select(*group, filled("en").alias("en"), filled("label").alias("label"), F.coalesce("originator", F.lit(False)).alias("o"), F.coalesce("price", F.lit(0)).alias("price"), "ordinal")
    of = rows.groupBy(*group).agg(F.bool_or("o").alias("has"), F.bool_or(F.col("o") & (F.col("en") != "")).alias("o_en"), F.bool_or(~F.col("o") & (F.col("en") != "")).alias("b_en"))
    named = rows.where("en <> ''").groupBy(*group, "o", "en").agg(F.min(F.struct((-F.col("price")).alias("price"), "ordinal", "label")).alias("x"))
    named = top_per_group(named.select(*group, "o", "x.*"), [*group, "o"], [F.asc("price"), F.asc("ordinal")], k).select(*group, F.when(F.col("o"), 0).otherwise(1).alias("kind"), "rank", "label")
    plain = top_per_group(rows.where("label <> '' AND NOT o").select(*group, "label").distinct(), group, [F.asc("label")], k).select(*group, F.lit(2).alias("kind"), "rank", "label")
    kind = F.when(F.col("has"), F.when(F.col("o_en"), 0).otherwise(2)).otherwise(F.when(F.col("b_en"), 1).otherwise(2))
    return named.union(plain).join(of.select(*group, kind.alias("kind")), [*group, "kind"]).select(*group, "rank", "label")


def combinations(products: DataFrame) -> DataFrame:
    """products (inn_keys, is_combo, combo_key, atc, sections) -> inn, is_combo_member, combo_keys, atc, sections, n_products: per ingredient the combinations it is part of, and what its products have, sorted."""
    flat = products.select(F.explode("inn_keys").alias("inn"), "is_combo", "combo_key", "atc", "sections")
    filled = lambda c: F.array_sort(F.collect_set(F.when(c != "", c)))
    combo = F.coalesce("is_combo", F.lit(False))
    return flat.groupBy("inn").agg(
        F.bool_or(combo).alias("is_combo_member"), filled(F.when(combo, F.col("combo_key"))).alias("combo_keys"), filled(F.col("atc")).alias("atc"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sections")))).alias("sections"), F.count(F.lit(1)).alias("n_products")
    )


def set_cover(sets: DataFrame, name: str, element: str) -> list[str]:
    """Greedy cover: names of sets, each the one that adds most (the smallest name among equals), until nothing is missing.

    Every round is one aggregation and one anti-join; only the chosen name comes to
    the driver, and there are as many rounds as chosen sets. What is still to cover is
    kept from one round to the next and let go after it.
    """
    rest = sets.select(name, element).distinct().persist()
    out: list[str] = []
    while True:
        best = rest.groupBy(name).agg(F.count(F.lit(1)).alias("gain")).orderBy(F.desc("gain"), F.asc(name)).first()
        if best is None:
            rest.unpersist()
            return out
        out.append(best[name])
        done = rest.where(F.col(name) == best[name]).select(element)
        left = rest.join(done, element, "left_anti").select(name, element).persist()
        left.count()
        rest.unpersist()
        rest = left


def content_mark(*columns) -> Column:
    """Aggregate that stands for the rows of a group in any order: their number, and the sum of a 60-bit hash of each; of fixed width at any size."""
    row = F.md5(F.concat_ws("|", *columns).cast("binary"))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(number.cast("decimal(28,0)")).cast("string"))


def brand_overview(products: DataFrame) -> DataFrame:
    """products (inn, inn_keys, route, brand_en, brand_zh, name_en, price, originator) -> one row per ingredient, route, partners and name in any case.

    Columns: partners (`+ …`, empty for the drug alone), name (the first spelling),
    originator, priced (any of its products), n, zh (names), and place: within its
    route the drug alone comes first, then partners by name; in each, priced before
    unpriced, originators before others, then by name in code-point order.
    """
    others = F.array_sort(F.filter("inn_keys", lambda k: k != F.col("inn")))
    partners = F.when(F.size(others) > 0, F.concat(F.lit("+ "), F.array_join(F.transform(others, F.initcap), " + "))).otherwise("")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.coalesce(filled("brand_en"), filled("brand_zh"), filled("name_en"), F.lit(""))
    rows = products.select("inn", "route", partners.alias("partners"), name.alias("name"), filled("brand_zh").alias("zh"), F.coalesce("originator", F.lit(False)).alias("originator"), (F.coalesce("price", F.lit(0.0)) != 0).alias("priced"))
    g = rows.groupBy("inn", "route", "partners", F.lower("name").alias("key")).agg(
        F.min("name").alias("name"), F.bool_or("originator").alias("originator"), F.bool_or("priced").alias("priced"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("zh")).alias("zh")
    )
    order = [(F.col("partners") != "").cast("int"), F.col("partners"), F.desc("priced"), F.desc("originator"), F.asc("name")]
    return g.drop("key").withColumn("place", F.row_number().over(Window.partitionBy("inn", "route").orderBy(*order)))


def representative(products: DataFrame, group: list[str], insert: str, originator: str, ordinal: str, payload: list[str]) -> DataFrame:
    """One product per group: the first originator with an insert, else the first with one; groups without have no row."""
    has = products.where(F.col(insert))
    best = F.min_by(F.struct(*payload), F.struct((~F.coalesce(originator, F.lit(False))).cast("int"), F.col(ordinal)))
    return has.groupBy(*group).agg(best.alias("x")).select(*group, "x.*")


def counters(rows: DataFrame, single: list[str], lists: list[str]) -> DataFrame:
    """kind, value, n: how often each value of the columns `single`, and of the array columns `lists`, comes; null does not count."""
    pair = lambda c, v: F.struct(F.lit(c).alias("kind"), v.cast("string").alias("value"))
    each = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: pair(c, v))
    of = [F.array(pair(c, F.col(c))) for c in single] + [each(c) for c in lists]
    return rows.select(F.inline(F.concat(*of))).where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def fingerprint(files: DataFrame, path: str, content: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 over all `path:sha256`, sorted and joined without a separator; of one row per file."""
    line = F.concat(F.col(path), F.lit(":"), F.sha2(F.col(content), 256))
    return files.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256), 1, 16).alias("fingerprint"))


def ingredient_tree(products: DataFrame) -> DataFrame:
    """products (inn_keys, route, sections, code, brand, price, drug_class) -> one row per ingredient with its routes nested.

    Flat rows are aggregated by ingredient and route first; only the nested view at the end collects, one entry per route.
    """
    flat = products.select(F.explode("inn_keys").alias("inn"), "*")
    low, high = price_range("price")
    per_route = flat.groupBy("inn", "route").agg(
        F.count_distinct("code").alias("n_products"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sections")))).alias("sections"),
        low.alias("price_min"),
        high.alias("price_max"),
        F.array_sort(F.collect_set("brand")).alias("brands"),
    )
    inner = F.struct("n_products", "sections", "price_min", "price_max", "brands")
    return per_route.groupBy("inn").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", inner.alias("x"))))).alias("routes"), F.sum("n_products").alias("n_entries"))
