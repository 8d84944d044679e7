"""Detail views of rule sections from the chapter layout, of which only the chapters that are asked for are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import chapter_no


def detail_view(spark: SparkSession, path: str, wanted: DataFrame, code: str = "code", pending: DataFrame | None = None) -> DataFrame:
    """The sections under `path` (partitioned by chapter, as `publish.write_chapters` writes them) whose code is wanted, each with its pending notices.

    The join has the chapter as a key, and the wanted codes, which are few, are
    broadcast: Spark prunes the chapters that none of them is in while it runs. pending
    (code, announced, notice) -> `pending`, an array of (announced, notice) by day, empty
    without one. Codes that are wanted twice, null or unknown give no row more.
    """
    codes = wanted.select(F.col(code).alias("code")).where(F.length("code") > 0).distinct().withColumn("chapter", chapter_no("code"))
    out = spark.read.parquet(path).join(F.broadcast(codes), ["chapter", "code"])
    if pending is None:
        return out.withColumn("pending", F.array().cast("array<struct<announced:string,notice:string>>"))
    notices = pending.where("code IS NOT NULL").join(F.broadcast(codes.select("code")), "code", "left_semi")
    notices = notices.groupBy("code").agg(F.array_sort(F.collect_list(F.struct(F.col("announced").cast("string").alias("announced"), "notice"))).alias("pending"))
    return out.join(notices, "code", "left").withColumn("pending", F.coalesce("pending", F.array().cast("array<struct<announced:string,notice:string>>")))
