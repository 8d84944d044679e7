"""Rows that hold from one date to another: what is valid on a day, and how one state becomes the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_status(rows: DataFrame, key: str, start: str, end: str, ordinal: str, as_of: str, payload: list[str]) -> DataFrame:
    """One row per key: status, current, upcoming, history.

    `start` and `end` are ISO texts; no start sorts first, no end is open. The
    current row is the latest to start of those that cover `as_of`, the upcoming
    one the first to start later. Without either, the last row is shown as
    delisted and stays part of its own history. One aggregation by key with
    partial results; no window is needed.
    """
    row = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), *payload)
    order = F.struct(F.coalesce(start, F.lit("")), ordinal)
    covers = (F.coalesce(start, F.lit("")) <= as_of) & (F.col(end).isNull() | (F.col(end) >= as_of))
    later = F.coalesce(start, F.lit("")) > as_of
    listed = F.collect_list(F.struct(order.alias("order"), row.alias("row")))
    g = rows.groupBy(key).agg(
        F.max_by(row, F.when(covers, order)).alias("current"),
        F.min_by(row, F.when(later, order)).alias("upcoming"),
        F.max_by(row, order).alias("last"),
        F.max(F.when(covers, order)).alias("__at"),
        F.sort_array(listed).alias("__all"),
    )
    status = F.when(F.col("current").isNotNull(), "active").when(F.col("upcoming").isNotNull(), "upcoming").otherwise("delisted")
    others = F.filter("__all", lambda x: F.col("__at").isNull() | (x["order"] != F.col("__at")))
    shown = F.when(status == "delisted", F.col("last")).otherwise(F.col("current"))
    return g.select(key, status.alias("status"), shown.alias("current"), "upcoming", F.transform(others, lambda x: x["row"]).alias("history"))


def past_rows(rows: DataFrame, key: str, start: str, end: str, ordinal: str, as_of: str) -> DataFrame:
    """The rows of `rows` that are not their key's current one on a day: its history, as rows, so that no key gathers them."""
    order = F.struct(F.coalesce(start, F.lit("")), F.col(ordinal))
    covers = (F.coalesce(start, F.lit("")) <= as_of) & (F.col(end).isNull() | (F.col(end) >= as_of))
    current = rows.groupBy(key).agg(F.max(F.when(covers, order)).alias("__at"))
    return rows.join(current, key).where(F.col("__at").isNull() | (order != F.col("__at"))).drop("__at")


def as_of_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """For every left row the right row of its key with the latest time not after its own.

    Both sides are put in one order per key and the last right row is carried on,
    so that the cost is one shuffle and sort, not a product of the two sides.
    """
    struct = F.struct(*columns)
    a = left.select(F.struct(*left.columns).alias("__left"), F.col(on).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(struct.alias("x")).schema["x"].dataType).alias("__right"))
    b = right.select(F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.col(on).alias("__k"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), struct.alias("__right"))
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__left.*", *(F.col(f"__found.{c}").alias(c) for c in columns))


def change_kind(old_file: Column, new_file: Column, old_sha: Column, new_sha: Column, old_date: Column, new_date: Column, failed: Column) -> Column:
    """What happened to a document from one manifest to the next; the first test that holds decides."""
    return (
        F.when(failed, F.when(old_sha.isNotNull(), "fetch_stale").otherwise("fetch_failed"))
        .when(new_file.isNull(), "gone")
        .when(old_file.isNull(), "new")
        .when(new_date < old_date, "unchanged")
        .when(old_file != new_file, "revised")
        .when(old_sha != new_sha, "silent_edit")
        .otherwise("unchanged")
    )


def compare_manifests(old: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """Full outer join of two manifests (key, file, effective, sha, first_seen | failed) -> kind and the manifest's next state.

    `first_seen` starts anew on a revision, the previous file is remembered until
    the next one, and an older date never replaces a newer one.
    """
    o = old.select(F.col(key).alias("k"), *(F.col(c).alias(f"old_{c}") for c in ("file", "effective", "sha", "first_seen", "prev_file")))
    n = new.select(F.col(key).alias("k"), *(F.col(c).alias(f"new_{c}") for c in ("file", "effective", "sha", "seen")), F.coalesce("failed", F.lit(False)).alias("failed"))
    j = o.join(n, "k", "full_outer").withColumn("failed", F.coalesce("failed", F.lit(False)))
    kind = change_kind(F.col("old_file"), F.col("new_file"), F.col("old_sha"), F.col("new_sha"), F.col("old_effective"), F.col("new_effective"), F.col("failed"))
    j = j.withColumn("kind", kind)
    takes = F.col("kind").isin("new", "revised", "silent_edit")
    pick = lambda c: F.when(takes, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
    return j.select(
        F.col("k").alias(key),
        "kind",
        pick("file").alias("file"),
        pick("effective").alias("effective"),
        pick("sha").alias("sha"),
        F.when(F.col("kind").isin("new", "revised"), F.col("new_seen")).otherwise(F.col("old_first_seen")).alias("first_seen"),
        F.when(F.col("kind") == "revised", F.col("old_file")).otherwise(F.col("old_prev_file")).alias("prev_file"),
    )


def overlay_newest(base: DataFrame, live: DataFrame, key: str = "code") -> DataFrame:
    """base (key, file, effective) with the live file where that differs and is not older."""
    n = live.select(F.col(key), F.col("file").alias("live_file"), F.col("effective").alias("live_effective"))
    j = base.join(n, key, "left")
    use = F.coalesce((F.col("live_file") != F.col("file")) & (F.col("live_effective") >= F.coalesce("effective", F.lit(""))), F.lit(False))
    return j.select(key, F.when(use, F.col("live_file")).otherwise(F.col("file")).alias("file"), F.when(use, F.col("live_effective")).otherwise(F.col("effective")).alias("effective"), use.alias("replaced"))
