"""Publishing: everything is staged, gated, and only then put in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import chapter_no, code_tuple
from ..functions.names import shard_name
from ..operators import gates


class GateFailure(RuntimeError):
    """Gates that failed; nothing was published."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stage(df: DataFrame, staging: str, name: str) -> DataFrame:
    """Write a table to the staging folder and read it back."""
    df.write.mode("overwrite").parquet(f"{staging}/{name}")
    return df.sparkSession.read.parquet(f"{staging}/{name}")


def promote(spark: SparkSession, staging: str, target: str, names: list[str], report: DataFrame) -> None:
    """Swap staged tables into place by rename, if no gate failed that was not overridden; the report is kept as the last run's."""
    failed = gates.failures(report)
    if failed:
        raise GateFailure("; ".join(failed))
    report.write.mode("overwrite").parquet(f"{staging}/_gates")
    for name in [*names, "_gates"]:
        fs, new = _fs(spark, f"{staging}/{name}")
        _, live = _fs(spark, f"{target}/{name}")
        _, old = _fs(spark, f"{target}/.{name}.old")
        fs.mkdirs(live.getParent())
        fs.delete(old, True)
        if fs.exists(live):
            fs.rename(live, old)
        if not fs.rename(new, live):
            fs.rename(old, live)
            raise RuntimeError(f"{name} could not be put in place")
        fs.delete(old, True)


def baseline(spark: SparkSession, target: str, counts: DataFrame) -> None:
    """Add this run's counts to the history that drift gates compare with."""
    counts.write.mode("append").parquet(f"{target}/_runs")


def write_shards(products: DataFrame, key: str, path: str) -> None:
    """A partition per ingredient; two keys with one shard name stop the run, and shards that are gone vanish."""
    rows = products.withColumn("shard", shard_name(key))
    clash = rows.groupBy("shard").agg(F.count_distinct(key).alias("n")).where("n > 1").select("shard").limit(5).collect()
    if clash:
        raise ValueError(f"several ingredients share {[r.shard for r in clash]}")
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def write_chapters(sections: DataFrame, code: str, path: str) -> None:
    """A partition per chapter, sections in natural order; detail views read only the chapters they need."""
    rows = sections.withColumn("chapter", chapter_no(code)).withColumn("sort_key", code_tuple(code))
    rows.repartition("chapter").sortWithinPartitions("chapter", "sort_key").write.mode("overwrite").partitionBy("chapter").parquet(path)


def slim(rows: DataFrame, columns: dict[str, str], note: str | None = None, longest: int = 600) -> DataFrame:
    """Columns under short names; a long note is cut and `note_more` says so."""
    out = [F.col(c).alias(short) for c, short in columns.items()]
    if note:
        out += [F.substring(note, 1, longest).alias("note"), (F.coalesce(F.length(note), F.lit(0)) > longest).alias("note_more")]
    return rows.select(*out)


def search_index(drugs: DataFrame, procedures: DataFrame) -> DataFrame:
    """Both kinds of entity in one table, told apart by `t`."""
    return drugs.withColumn("t", F.lit("d")).unionByName(procedures.withColumn("t", F.lit("p")), allowMissingColumns=True)


def scoped(rows: DataFrame, key: str, used: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rows that a scope uses, without those that are excluded."""
    out = rows.join(used.select(key).distinct(), key, "left_semi")
    return out if excluded is None else out.join(excluded.select(key).distinct(), key, "left_anti")


def money(price: Column) -> Column:
    """`$` with up to two decimals; null and 0 are unlisted."""
    text = F.regexp_replace(F.format_number(price, 2), r"\.?0+$", "")
    return F.when(F.coalesce(price, F.lit(0.0)) == 0, "unlisted").otherwise(F.concat(F.lit("$"), text))


def metadata(tables: dict[str, DataFrame], built: str, fingerprint: str) -> DataFrame:
    """One row: when built, the content's fingerprint, and the number of rows of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = one if out is None else out.crossJoin(one)
    return out.withColumn("built", F.lit(built)).withColumn("fingerprint", F.lit(fingerprint))
