"""What differs between two releases of a table, found without reading what is equal: a Merkle tree over ranges of keys.

A table is stored by ranges of its key (the leaves), each with a mark of its rows; a
node's mark is made of its children's. Two tables stored with the same ranges are
compared from the root: only below nodes that differ are children looked at, and only
rows of leaves that differ are read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Children of a node.
FAN = 16
#: Keys that are looked at to place the ranges; whatever the ranges, results are the same.
SAMPLE = 20_000
TREE = "level int, node int, mark string, n long"


def ranges(df: DataFrame, key: str, leaves: int = 256) -> list:
    """First keys of `leaves` ranges (but for the first one) with about as many keys each, from a bounded sample of the smallest hashes."""
    keys = df.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    got = sorted(r.k for r in keys.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect())
    cuts = [got[len(got) * i // leaves] for i in range(1, leaves)] if got else []
    return sorted(set(cuts))


def leaf_of(key: Column, cuts: Sequence) -> Column:
    """Number of a key's range: how many cuts are at most the key, counted over every 64th cut first; null is in the first range."""
    if not cuts:
        return F.lit(0)
    step = 64
    coarse, fine = list(cuts[::step]), [list(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    at_most = lambda values: F.size(F.filter(values, lambda c: c <= key))
    lit = lambda values: F.array(*(F.lit(v) for v in values))
    block = at_most(lit(coarse))
    inner = F.coalesce(at_most(F.get(F.array(*(lit(x) for x in fine)), block - 1)), F.lit(0))
    return F.when(key.isNull() | (block <= 0), 0).otherwise((block - 1) * step + inner).cast("int")


def _number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(28,0)")


def mark(*columns: str) -> Column:
    """Aggregate that stands for a set of rows in any order, with repeated rows: their number and two sums of 60 bits of each row's digest."""
    digest = F.md5(F.to_json(F.struct(*columns)).cast("binary"))
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(_number(digest, 1)).cast("string"), F.sum(_number(digest, 16)).cast("string"))


def store(df: DataFrame, key: str, path: str, cuts: Sequence) -> None:
    """Write a table to path/rows, a folder for each range, and its tree to path/tree: leaves are level 0, a node of the next level stands for FAN of them, and so on up to one root."""
    spark, columns = df.sparkSession, df.columns
    if "leaf" in columns:
        raise ValueError("leaf is a column of its own here")
    df.withColumn("leaf", leaf_of(F.col(key), cuts)).repartition("leaf").write.partitionBy("leaf").parquet(f"{path}/rows")
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/schema")
    rows = stored_rows(spark, path)
    levels = [rows.groupBy(F.col("leaf").alias("node")).agg(mark(*columns).alias("mark"), F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("level"), "node", "mark", "n")]
    top = len(cuts)  # the last leaf's number
    while top > 0:
        top //= FAN
        below = levels[-1]
        children = F.array_sort(F.collect_list(F.struct("node", "mark")))  # at most FAN
        digest = F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["node"].cast("string"), c["mark"])), ";"), 256)
        levels.append(below.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("parent")).agg(digest.alias("mark"), F.sum("n").alias("n")).select((F.lit(len(levels))).alias("level"), F.col("parent").alias("node"), "mark", "n"))
    tree = levels[0]
    for x in levels[1:]:
        tree = tree.union(x)
    tree.coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table with their leaf; an empty table has its columns too."""
    schema = T.StructType.fromJson(json.loads(spark.read.schema("schema string").parquet(f"{path}/schema").first()["schema"]))
    return spark.read.schema(schema.add("leaf", T.IntegerType())).parquet(f"{path}/rows")


def differing_leaves(spark: SparkSession, old: str, new: str) -> tuple[list[int], int]:
    """Leaves whose rows are not the same, and how many nodes were compared to find them."""
    trees = [spark.read.schema(TREE).parquet(f"{p}/tree") for p in (old, new)]
    tops = [t.agg(F.max("level")).first()[0] for t in trees]
    top = max((t for t in tops if t is not None), default=None)
    if top is None:
        return [], 0
    if None not in tops and tops[0] != tops[1]:
        raise ValueError("the two tables are not stored by the same ranges")
    open_, compared = [0], 0
    for level in range(top, -1, -1):
        a, b = (t.where((F.col("level") == level) & F.col("node").isin(open_)).select("node", "mark") for t in trees)
        nodes = a.withColumnRenamed("mark", "a").join(b.withColumnRenamed("mark", "b"), "node", "full_outer").collect()  # at most as many as there are ranges
        compared += len(nodes)
        differ = sorted(r["node"] for r in nodes if r["a"] != r["b"])
        if level == 0 or not differ:
            return differ, compared
        open_ = [FAN * n + i for n in differ for i in range(FAN)]
    return [], compared


def changes(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """key, kind (added, removed, changed), columns (that changed, in order; empty for the others): what differs between two stored tables.

    Only the ranges that differ are read. Rows that share a key are compared as a set: what
    has changed then is a column whose values, counted, are not the same. A null key is a key.
    """
    leaves, _ = differing_leaves(spark, old, new)
    sides = [stored_rows(spark, p).where(F.col("leaf").isin(leaves)) for p in (old, new)]
    columns = [c for c in sides[0].columns if c not in ("leaf", key)]
    if set(columns) != {c for c in sides[1].columns if c not in ("leaf", key)}:
        raise ValueError("the two tables have other columns")
    marked = [s.groupBy(F.col(key).alias("k")).agg(F.array(*(mark(c) for c in columns)).alias("m")) for s in sides]
    both = marked[0].withColumnsRenamed({"k": "k0", "m": "m0"}).join(marked[1].withColumnsRenamed({"k": "k1", "m": "m1"}), F.col("k0").eqNullSafe(F.col("k1")), "full_outer")
    names = F.array(*(F.lit(c) for c in columns))
    changed = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.when(F.get("m0", i) != F.get("m1", i), F.get(names, i))), lambda c: c.isNotNull())
    kind = F.when(F.col("m0").isNull(), "added").when(F.col("m1").isNull(), "removed").otherwise("changed")
    out = both.select(F.coalesce("k0", "k1").alias(key), kind.alias("kind"), F.when(kind == "changed", changed).otherwise(F.array().cast("array<string>")).alias("columns"))
    return out.where("kind <> 'changed' OR size(columns) > 0")
