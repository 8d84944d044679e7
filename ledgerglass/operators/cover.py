"""Greedy cover by lazy evaluation: what a set adds only ever shrinks, so that an old figure is an upper bound.

A round looks at the sets with the greatest bounds only: their missing elements, a
bounded number, meet in one task, which takes the best set again and again as long as
none of the others, even at its old bound, could come before it. What the looked-at sets
add now are their next bounds. A round so takes many sets, where the plain way takes a round
for each. After one that takes none, all bounds are counted anew, and the next takes one at least.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written


def lazy_cover(sets: DataFrame, name: str, element: str, batch: int = 4096, elements: int = 200_000) -> DataFrame:
    """place, name, gain: the greedy cover of all elements, in order; of equal gains the smallest name comes first.

    A round looks at no more than `batch` sets with `elements` elements together; a set
    larger than that is looked at by its count alone. Null names and elements are left out,
    repeated rows count once, and an empty table has no cover.
    """
    base = written(sets.select(F.col(name).alias("name"), F.col(element).alias("element")).where("name IS NOT NULL AND element IS NOT NULL").distinct(), "cover-sets")
    bounds = written(base.groupBy("name").agg(F.count(F.lit(1)).alias("bound")), "cover-bounds")
    kind = base.schema["name"].dataType
    picks = base.sparkSession.createDataFrame([], T.StructType([T.StructField("place", T.LongType()), T.StructField("name", kind), T.StructField("gain", T.LongType())]))
    covered, taken = None, 0
    order = [F.desc("bound"), F.asc("name")]
    while True:
        # one row per set, of which only the first few are kept: a top-k, no sort of all
        top = bounds.where("bound > 0").orderBy(*order).limit(batch + 1)
        top = top.withColumn("before", F.sum("bound").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("bound")).withColumn("r", F.row_number().over(Window.orderBy(*order)))
        rows = top.orderBy("r").collect()
        if not rows:
            return picks
        n = sum(1 for x in rows if x["r"] <= batch and x["before"] + x["bound"] <= elements)
        large = n == 0  # the first set alone has more
        n = max(n, 1)
        limit = (rows[n]["bound"], rows[n]["name"]) if len(rows) > n else None
        names = top.where(F.col("r") <= n).select("name")
        left = base.join(F.broadcast(names), "name")
        if covered is not None:
            left = left.join(covered, "element", "left_anti")
        if large:
            gain = left.count()
            found = base.sparkSession.createDataFrame([(rows[0]["name"], gain)], T.StructType([T.StructField("name", kind), T.StructField("gain", T.LongType())]))
            certain = gain > 0 and (limit is None or gain > limit[0] or (gain == limit[0] and rows[0]["name"] < limit[1]))
            round_ = found.select("name", F.when(F.lit(certain), 1).otherwise(0).cast("long").alias("place"), "gain", F.when(F.lit(certain), 0).otherwise(F.col("gain")).cast("long").alias("bound"))
        else:
            round_ = names.join(left, "name", "left").groupBy(F.lit(0).alias("all")).applyInPandas(_take(limit), T.StructType([T.StructField("name", kind), T.StructField("place", T.LongType()), T.StructField("gain", T.LongType()), T.StructField("bound", T.LongType())]))
        round_ = written(round_, "cover-round")
        more = round_.where("place > 0").count()
        if more:
            picks = written(picks.union(round_.where("place > 0").select(F.col("place") + taken, "name", "gain")), "cover-picks")
            taken += more
            covered = written(base.join(F.broadcast(picks.select("name")), "name").select("element").distinct(), "cover-done")
        if not more:
            rest = base if covered is None else base.join(covered, "element", "left_anti")
            bounds = written(rest.groupBy("name").agg(F.count(F.lit(1)).alias("bound")), "cover-bounds")
            continue
        bounds = written(bounds.join(F.broadcast(round_.select("name", F.col("bound").alias("now"))), "name", "left").select("name", F.coalesce("now", "bound").alias("bound")), "cover-bounds")


def _take(limit: tuple | None):
    """Rows (name, element) of the looked-at sets -> a row for each: its place from 1 on if it is taken, else 0, what it added, and its next bound."""

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        missing = {n: set(g.dropna()) for n, g in rows.groupby("name")["element"]}
        out = []
        while missing:
            best = min(missing, key=lambda n: (-len(missing[n]), n))
            gain = len(missing[best])
            if not gain or (limit is not None and (-gain, best) > (-limit[0], limit[1])):
                break  # nothing is missing, or a set that is not looked at may come first
            gone = missing.pop(best)
            out.append((best, len(out) + 1, gain, 0))
            for s in missing.values():
                s -= gone
        out += [(n, 0, 0, len(s)) for n, s in missing.items()]
        return pd.DataFrame(out, columns=["name", "place", "gain", "bound"])

    return take
