"""Releases: tables that are published together or not at all.

    root/versions/<version>/<table>/   written once and never changed
    root/log/<number>.json             one entry per release; the highest number is the current one

A release is staged under a version of its own, gated there, and becomes current by
the rename of its log entry to the next number, which fails if another release has
taken that number meanwhile: the one step that anybody sees. A crash before it leaves
the old release as it was, and a version that nothing refers to. Readers open a
release once and go on reading its version, whatever is published after. The log is
also the history that drift gates compare with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates
from .publish import GateFailure

ENTRY = "number long, version string, base long, tables map<string, long>, overridden array<int>, published string, note string"


class ReleaseConflict(RuntimeError):
    """Another release was published meanwhile; what was staged is in place and can be published on top of it."""


@dataclass(frozen=True)
class Release:
    """One entry of the log; its tables stay the same as long as its version is kept."""

    spark: SparkSession = field(repr=False, compare=False)
    root: str
    number: int
    version: str
    tables: dict[str, int]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"release {self.number} has no table {name}")
        return self.spark.read.parquet(f"{self.root}/versions/{self.version}/{name}")

    def gates(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/{self.version}/_gates")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, log, _ = _hadoop(spark, f"{root}/log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, root: str, number: int) -> dict:
    fs, path, _ = _hadoop(spark, f"{root}/log/{number:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write_table(df: DataFrame, path: str, by: Sequence[str]) -> None:
    if by:
        df.repartition(*by).write.partitionBy(*by).parquet(path)
    else:
        df.write.parquet(path)


def _write_report(report: DataFrame, path: str) -> None:
    report.write.parquet(path)


def _write_entry(spark: SparkSession, root: str, entry: dict) -> str:
    """The entry under a name that no reader looks at."""
    fs, path, _ = _hadoop(spark, f"{root}/log/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
    finally:
        stream.close()
    return path.toString()


def _switch(spark: SparkSession, root: str, temporary: str, number: int) -> None:
    """Rename an entry to its number, without overwriting: the same way in which Spark commits a streaming batch."""
    _, old, jvm = _hadoop(spark, temporary)
    new = jvm.Path(f"{root}/log/{number:012d}.json")
    context = jvm.FileContext.getFileContext(new.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(old, new, plain)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise ReleaseConflict(f"release {number} was published by somebody else") from None
        raise


def _commit(spark: SparkSession, root: str, base: int, version: str, tables: dict[str, int], overridden: Sequence[int], note: str) -> Release:
    number = base + 1
    entry = {"number": number, "version": version, "base": base, "tables": tables, "overridden": list(overridden), "published": datetime.now(UTC).isoformat(timespec="seconds"), "note": note}
    temporary = _write_entry(spark, root, entry)
    try:
        _switch(spark, root, temporary, number)
    except ReleaseConflict:
        fs, path, _ = _hadoop(spark, temporary)
        fs.delete(path, False)
        raise
    return Release(spark, root, number, version, tables)


def current(spark: SparkSession, root: str, number: int | None = None) -> Release | None:
    """The release with a number, else the newest one; None if nothing was published."""
    known = _numbers(spark, root)
    if number is None and not known:
        return None
    if number is not None and number not in known:
        raise KeyError(f"there is no release {number}")
    e = _read(spark, root, known[-1] if number is None else number)
    return Release(spark, root, e["number"], e["version"], e["tables"])


def publish(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], rules: Sequence[gates.Gate] = (), override: tuple[int, ...] = (), partition_by: dict[str, Sequence[str]] | None = None, base: int | None = None, note: str = ""
) -> Release:
    """Stage, gate, switch. The release that comes out has all of `tables`; those of earlier releases are not carried over.

    Gates run over the tables as they were written. If one fails that is not
    overridden, or if a release other than `base` (the newest one when publishing began) has
    become current, nothing changes for readers.
    """
    known = _numbers(spark, root)
    base = (known[-1] if known else 0) if base is None else base
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    for name, df in tables.items():
        if name.startswith(("_", ".")):
            raise ValueError(f"{name} is no name for a table")
        _write_table(df, f"{folder}/{name}", (partition_by or {}).get(name, ()))
    staged = {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}
    overridden: list[int] = []
    if rules:
        _write_report(gates.run(list(rules), staged, override), f"{folder}/_gates")
        report = spark.read.parquet(f"{folder}/_gates")
        if failed := gates.failures(report):
            raise GateFailure("; ".join(failed))
        overridden = sorted(r.id for r in report.where("overridden AND NOT passed").collect())
    return _commit(spark, root, base, version, {n: df.count() for n, df in staged.items()}, overridden, note)


def rollback(spark: SparkSession, root: str, number: int, note: str = "") -> Release:
    """Make an earlier release current again, as a new release with the same tables; nothing is copied."""
    old = current(spark, root, number)
    fs, folder, _ = _hadoop(spark, f"{root}/versions/{old.version}")
    if not fs.exists(folder):
        raise KeyError(f"the tables of release {number} have been removed")
    return _commit(spark, root, _numbers(spark, root)[-1], old.version, old.tables, (), note or f"rollback to {number}")


def history(spark: SparkSession, root: str) -> DataFrame:
    """number, table, n_rows, change (from the last release that had the table, null for the first), overridden, published, note."""
    if not _numbers(spark, root):
        log = spark.createDataFrame([], ENTRY)
    else:
        log = spark.read.schema(ENTRY).option("pathGlobFilter", "[0-9]*.json").json(f"{root}/log")
    rows = log.select("number", F.explode("tables").alias("table", "n_rows"), "overridden", "published", "note")
    before = F.expr("lag(n_rows) OVER (PARTITION BY table ORDER BY number)")
    return rows.select("number", "table", "n_rows", (F.col("n_rows") - before).alias("change"), "overridden", "published", "note")


def drift_gates(spark: SparkSession, root: str, share: float = 0.10, first_id: int = 900) -> list[gates.Gate]:
    """For each table of the current release, that its rows stay within a share of what they are; none before the first."""
    now = current(spark, root)
    return [gates.drift(first_id + i, f"{t} drift", t, n, share) for i, (t, n) in enumerate(sorted(now.tables.items()))] if now else []


def expire(spark: SparkSession, root: str, keep: int = 3, orphan_hours: float = 24) -> list[str]:
    """Remove versions that none of the last `keep` releases has; versions without a release only when they are old, since somebody may be staging them."""
    if keep < 1:
        raise ValueError("the current release is always kept")
    entries = [_read(spark, root, n) for n in _numbers(spark, root)]
    kept, known = {e["version"] for e in entries[-keep:]}, {e["version"] for e in entries}
    fs, folder, _ = _hadoop(spark, f"{root}/versions")
    gone = []
    for s in fs.listStatus(folder) if fs.exists(folder) else ():
        name, age = s.getPath().getName(), datetime.now(UTC).timestamp() - s.getModificationTime() / 1000
        if name not in kept and (name in known or age > 3600 * orphan_hours):
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
