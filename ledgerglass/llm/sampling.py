"""Bounded samples of labelled rows, and the rows that a fit never sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo `divisor`; null where the id is."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def bounded(rows: DataFrame, by: str, limit: int, seed: str = "sample") -> DataFrame:
    """At most `limit` rows, the same in each run: those with the smallest hashes of column `by`.

    A threshold derived from the row count leaves about twice as many rows before the exact cut.
    """
    n = rows.count()
    h = F.xxhash64(F.lit(seed), F.col(by)).bitwiseAND((1 << 30) - 1)
    if n > 4 * limit:
        rows = rows.where(h < int((1 << 30) * 2 * limit / n) + 1)
    return rows.orderBy(h, by).limit(limit)
