"""Readers with a contract: wrong headers, incomplete pages and missing tables are found before any row is used."""

from __future__ import annotations

import io
import json
import math
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The columns of the two master files, in their order.
DRUG_COLUMNS = "異動 藥品代號 藥品英文名稱 藥品中文名稱 成分 規格量 規格單位 單複方 支付價 有效起日 有效迄日 藥商 製造廠名稱 劑型 藥品分類 分類分組名稱 ATC代碼 給付規定章節 藥品代碼超連結 給付規定章節連結".split()
PROCEDURE_COLUMNS = "診療項目代碼 健保支付點數 生效起日 生效迄日 英文項目名稱 中文項目名稱 備註".split()


class ContractError(ValueError):
    """An input that is not what was agreed."""


def csv_master(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with exactly these columns, all text; a byte order mark is dropped, long and multi-line fields are read whole."""
    head = spark.read.option("header", True).option("multiLine", True).option("inferSchema", False).csv(path).columns
    if [c.lstrip("﻿").strip() for c in head] != columns:
        raise ContractError(f"columns are {head}, not {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True, multiLine=True, maxCharsPerColumn=-1, mode="FAILFAST", escape='"')


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of one JSON array per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def zipped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of the array in the first .json member of every zip file; a task unpacks a file at a time."""
    kind = T._parse_datatype_string(schema)

    def unpack(frames):
        for pdf in frames:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.endswith(".json")), None)
                    rows = json.loads(z.read(name)) if name else []
                yield pd.DataFrame([json.dumps(r, ensure_ascii=False) for r in rows], columns=["row"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return files.mapInPandas(unpack, "row string").select(F.from_json("row", kind).alias("r")).select("r.*")


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def manifest_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a text's `KEY: value` lines."""
    lines = spark.read.text(path)
    pattern = r"^\s*([A-Za-z_][\w -]*?)\s*:\s*(\S+)"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value"))


def directory(spark: SparkSession, path: str, glob: str = "*", exclude: DataFrame | None = None) -> DataFrame:
    """path (below the root), length, sha256 of all files under a directory, but those excluded."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = files.select(F.substring(plain(F.col("path")), len(root) - len("file:") + 1 if root.startswith("file:/") and not root.startswith("file:///") else len(root.replace("file:///", "/")) + 1, 1 << 20).alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    return rows if exclude is None else rows.join(exclude.select("path"), "path", "left_anti")


def text_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """code, effective, seq, text of section snapshots `<code>_<yyyymmdd>[_<seq>].txt`."""
    from ..functions.codes import parse_file_name

    files = spark.read.text(path, wholetext=True).withColumn("name", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", ".pdf"))
    return files.select(parse_file_name("name").alias("f"), F.col("value").alias("text")).where("f is not null").select("f.*", "text")


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, total: int, size: int, names: list[str]):
        self.fetch, self.total, self.size, self.names = fetch, total, size, names

    def partitions(self):
        return [_Page(k + 1) for k in range(math.ceil(self.total / self.size))] or [_Page(0)]

    def read(self, partition):
        if partition.number:
            for row in self.fetch(partition.number, self.size):
                yield tuple(row.get(n) for n in self.names)


def paged(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, schema: str, size: int = 50, name: str = "paged_api") -> DataFrame:
    """All rows of a paged service: a partition per page. `fetch(page, size)` runs in the tasks, so it must be picklable."""

    columns = T._parse_datatype_string(schema).names

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _PagedReader(fetch, total, size, columns)

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


def complete_or(new: DataFrame, total: int, old: DataFrame) -> DataFrame:
    """The new rows if all that the service announced came, else the old table. They are fetched once: what is counted is what is returned."""
    from .scratch import written

    new = written(new, "fetched")
    return new if new.count() >= total else old


def latest_files(rows: DataFrame, key: str, files: str) -> DataFrame:
    """key, section, file, effective: from comma-separated file names, the newest of each section of a key; what is no file name is skipped."""
    from ..functions.codes import parse_file_name

    each = rows.select(key, F.explode(F.split(F.coalesce(files, F.lit("")), ",")).alias("file")).select(key, F.trim("file").alias("file")).withColumn("f", parse_file_name("file")).where("f is not null")
    g = each.groupBy(key, "f.code").agg(F.max_by(F.struct("file", "f.effective"), F.struct("f.effective", F.coalesce("f.seq", F.lit(-1)), "file")).alias("x"))
    return g.select(key, F.col("code").alias("section"), "x.file", "x.effective")


def newest_of(files: str):
    """Of comma-separated file names, per section the struct(code, effective, seq) with the latest date, then the largest number."""
    from ..functions.binding import let
    from ..functions.codes import parse_file_name

    found = F.filter(F.transform(F.split(F.coalesce(F.col(files), F.lit("")), ","), lambda f: parse_file_name(F.trim(f))), lambda f: f.isNotNull())
    order = lambda f: F.struct(f["effective"].alias("effective"), F.coalesce(f["seq"], F.lit(-1)).alias("seq"))
    best = lambda parsed, code: F.array_max(F.transform(F.filter(parsed, lambda f: f["code"] == code), order))
    row = lambda parsed: lambda c: let(best(parsed, c), lambda b: F.struct(c.alias("code"), b["effective"].alias("effective"), b["seq"].alias("seq")))
    return let(found, lambda parsed: F.transform(F.array_distinct(F.transform(parsed, lambda f: f["code"])), row(parsed)))
