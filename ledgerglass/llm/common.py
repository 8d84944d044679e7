"""Helpers shared by the corpus operators: tables in the shared folder, joins by measured size, components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size is at most this; otherwise Spark shuffles both sides.
BROADCAST_BYTES = 24 << 20

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="ledgerglass-")
    return _own_dir[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, whatever file system it is on."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends unless `discard` has removed it before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete tables right below a folder (those with Spark's _SUCCESS mark), in order; none if there is no folder."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def discard(*tables: DataFrame) -> None:
    """Remove tables made by `written` whose consumers have all been written themselves."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path:
            delete(t.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark removes shuffles and broadcasts only when nothing there refers to them, and the heap shrinks to what is in use."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of texts that a task holds at once on their way to Python and back.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have at most BATCH_ROWS rows in this session: texts are long, and a task's memory is to stay bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder (or to `path`) and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def join_by_size(big: DataFrame, small: DataFrame, on, how: str, small_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a broadcast of `small` if its measured size is within `limit`, else by shuffle (skewed keys are split by AQE)."""
    return big.join(F.broadcast(small) if small_bytes <= limit else small.hint("merge"), on, how)


def semi_join(big: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `big` whose key is in `keys`.

    The keys are written first (if they aren't yet): then their size is known, and neither side
    has an aggregate between its shuffle and the join, so that Spark can split a frequent key.
    """
    if not hasattr(keys, "written_to"):
        keys = written(keys.select(*on), "keys")
    return join_by_size(big, keys.select(*on), on, "left_semi", 24 * len(on) * keys.count(), limit)


def components(edges: DataFrame, nodes: Sequence[str] = ("a", "b"), max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), the component being its smallest node.

    Alternates large-star and small-star steps on the edge table until no edge
    changes. A round makes at most one edge of each edge and one more for each
    node, writes those that differ, reduces a node with very many neighbours by a
    partial minimum, and collects nothing. Nodes without an edge do not appear.
    """
    a, b = nodes
    cur = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges"
    )
    seen = None
    state = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    now = cur.agg(*state).first()
    for _ in range(max_rounds):
        size = 96 * now[0]  # two nodes an edge at most
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_by_size(both.where("v > u"), low, "u", "inner", size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_by_size(large, low, "u", "inner", size).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        cur = written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        seen, now = now, cur.agg(*state).first()
        if now == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
