"""Licences: numbers, preference among equal ones, and the tiered join of products with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-digit prefixes of licence numbers and the series they stand for.
PREFIXES = {
    "01": "衛署藥製字", "02": "衛署藥輸字", "09": "衛署菌疫製字", "10": "衛署菌疫輸字", "12": "內衛藥製字",
    "20": "衛署罕藥輸字", "21": "衛署罕藥製字", "22": "衛署罕菌疫輸字", "51": "衛部藥製字", "52": "衛部藥輸字",
    "59": "衛部菌疫製字", "60": "衛部菌疫輸字", "70": "衛部罕藥輸字", "71": "衛部罕藥製字", "72": "衛部罕菌疫輸字",
}
NUMBER = r"^(.+?字)第0*(\d+)號"


def id_from_url(url) -> Column:
    """What follows the last `licId=` up to the next `&`."""
    u = F.col(url) if isinstance(url, str) else url
    return F.when(F.contains(u, F.lit("licId=")), F.substring_index(F.substring_index(u, "licId=", -1), "&", 1))


def id_to_key(lic_id) -> Column:
    """struct(series, serial), null for an unknown prefix or anything but digits."""
    s = F.trim(F.col(lic_id) if isinstance(lic_id, str) else lic_id)
    series = F.try_element_at(F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv)), F.substring(s, 1, 2))
    ok = s.rlike(r"^\d{3,}$") & series.isNotNull()
    return F.when(ok, F.struct(series.alias("series"), F.substring(s, 3, 99).try_cast("bigint").cast("string").alias("serial")))


def number_to_key(number) -> Column:
    n = F.col(number) if isinstance(number, str) else number
    return F.when(n.rlike(NUMBER), F.struct(F.regexp_extract(n, NUMBER, 1).alias("series"), F.regexp_extract(n, NUMBER, 2).alias("serial")))


def prefer_active(rows: DataFrame, key: list[str], cancelled: str, ordinal: str, payload: list[str]) -> DataFrame:
    """One row per key: the first that is not cancelled, else the first; an aggregation, so that no key gathers its rows."""
    off = (F.trim(F.coalesce(cancelled, F.lit(""))) != "").cast("int")
    return rows.groupBy(*key).agg(F.min_by(F.struct(*payload), F.struct(off, F.col(ordinal))).alias("x")).select(*key, "x.*")


def classify(found: Column, cancelled: Column) -> Column:
    """miss, active or stale: decided after the join, as cancelled licences still count for their products."""
    return F.when(~found, "miss").when(F.trim(F.coalesce(cancelled, F.lit(""))) == "", "active").otherwise("stale")


def tiered_join(products: DataFrame, licences: DataFrame, key: list[str], cancelled: str) -> DataFrame:
    """Products with their licence's columns and `licence_state`."""
    j = products.join(licences.withColumn("__found", F.lit(True)), key, "left")
    return j.withColumn("licence_state", classify(F.coalesce("__found", F.lit(False)), F.col(cancelled))).drop("__found")


def with_flag(rows: DataFrame, key: str, members: DataFrame, flag: str) -> DataFrame:
    """`rows` with whether `key` is among `members`: a left join on distinct keys."""
    m = members.select(F.col(key)).where(F.trim(F.col(key).cast("string")) != "").distinct().withColumn(flag, F.lit(True))
    return rows.join(m, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
