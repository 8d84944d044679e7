"""Mixing sources to target weights.

Sizes are words; a source's target is its weight's part of `budget` times all
words, at most `most` times its own, and what that cuts off is shared again by
weight. A document of a source with rate r = target / size is taken floor(r)
times, and once more if a number drawn from its id by hash is below r's fraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import blocks
from .common import join_by_size, small_batches, written

WEIGHTS = (5, 2, 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def count_words(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """`docs` with its text replaced by the number of runs of bytes that are no ASCII white space; null has none."""
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != text]

    def scan(batches):
        for batch in batches:
            out = []
            for _, data, offsets in blocks(batch.column(text)):
                solid = ~_SPACE[data]
                start = solid.copy()
                start[1:] &= ~solid[:-1]
                inner = offsets[offsets < len(data)]
                start[inner] = solid[inner]
                out.append(np.diff(np.concatenate(([0], np.cumsum(start)))[offsets]))
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(np.concatenate(out).astype(np.int64))], names=[*(f.name for f in keep), size])

    return docs.mapInArrow(scan, T.StructType([*keep, T.StructField(size, T.LongType())]))


def source_targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, size) -> source, source_size, target: one row per source, null a source of its own, last.

    The windows run over one row per source, never over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = by_source.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn("budget", budget * F.sum("source_size").over(all_rows))
    # sources reach their cap in the order of cap / weight; what is left after those before goes to the others by weight
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("rank", F.row_number().over(order))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("budget") - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("rank"))).over(all_rows)
    return rows.withColumn("lambda", level).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("lambda") * F.col("w")).alias("target"))


def draw(doc_id: str, text: str):
    """A number from 0 to 1 that depends on the id alone, or on the text where there is none."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), key)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def plan(docs: DataFrame, budget: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken.

    Texts without words and sources without words are taken 0 times. Rows with
    the same id draw the same number, so a repeated row is taken as often as the first.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), draw(doc_id, text).alias("u"), F.col(text).alias("text"))
    rows = written(count_words(rows), "sizes")
    targets = written(source_targets(rows.select("source", "size"), budget, most), "targets").withColumnRenamed("source", "__source")
    bytes_of = targets.agg(F.sum(48 + F.coalesce(F.octet_length("__source"), F.lit(0)))).first()[0] or 0
    out = join_by_size(rows, targets, F.col("source").eqNullSafe(F.col("__source")), "inner", bytes_of).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("u") < rate - F.floor(rate)).cast("long")
    return out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def emit(docs: DataFrame, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Every document as often as the mix takes it, numbered from 1 on by `mix_copy`; the other columns are kept as they are.

    Where there is a column `mix_copy` already, the new one is the first of mix_copy1, mix_copy2, ... that is free.
    """
    number = next(f"mix_copy{i or ''}" for i in range(len(docs.columns) + 1) if f"mix_copy{i or ''}" not in docs.columns)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), F.col("text").alias("text"), draw("doc_id", "text").alias("u"))
    targets = written(source_targets(count_words(rows.select("source", "text")), budget, most), "targets")
    targets = targets.select(F.col("source").alias("of"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    bytes_of = targets.agg(F.sum(48 + F.coalesce(F.octet_length("of"), F.lit(0)))).first()[0] or 0
    rows = join_by_size(rows, targets, F.col("source").eqNullSafe(F.col("of")), "inner", bytes_of)
    copies = F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("long")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = rows.select("row", F.when(has_words, copies).otherwise(0).cast("int").alias("copies")).where("copies > 0")
    return rows.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(number))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST(('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, 2.0::DOUBLE * source_size AS cap,
      1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
r AS (SELECT *, row_number() OVER o AS rank, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
l AS (SELECT *, (budget - before) / open AS level, cap / w <= (budget - before) / open AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (SELECT level FROM l WHERE NOT capped ORDER BY rank LIMIT 1) * w END AS target FROM l),
j AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
