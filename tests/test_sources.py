import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerglass.operators import aggregates, gates, temporal
from ledgerglass.sources import publish, readers
from ledgerglass.streaming import manifest


def test_csv_contract(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    head = ",".join(readers.PROCEDURE_COLUMNS)
    (tmp_path / "p.csv").write_text("﻿" + head + '\n51018C,100,1120101,9991231,UV,"光化\n治療",note\n', encoding="utf-8")
    rows = readers.csv_master(spark, path, readers.PROCEDURE_COLUMNS).collect()
    assert len(rows) == 1 and rows[0][0] == "51018C" and rows[0][5] == "光化\n治療"
    with pytest.raises(readers.ContractError):
        readers.csv_master(spark, path, readers.DRUG_COLUMNS)


def test_json_and_zip(spark, tmp_path):
    data = [{"no": "1", "x": "a"}, {"no": "2"}]
    (tmp_path / "a.json").write_text(json.dumps(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("in.json", json.dumps(data))
    schema = "no string, x string"
    for df in (readers.json_array(spark, str(tmp_path / "a.json"), schema), readers.zipped_json(spark, str(tmp_path), schema)):
        assert {tuple(r) for r in df.collect()} == {("1", "a"), ("2", None)}


def test_paged(spark):
    def fetch(page, size):
        return [{"id": i, "name": f"n{i}"} for i in range((page - 1) * size, min(page * size, 123))]

    df = readers.paged(spark, fetch, 123, "id int, name string")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 123
    assert readers.complete_or(df, 124, df.limit(1)).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("version: 3\nfingerprint: abc\nother line\n")
    (tmp_path / "d" / "e" / "b.txt").write_text("x")
    assert {tuple(r) for r in readers.manifest_values(spark, str(tmp_path / "d" / "a.txt")).collect()} == {("version", "3"), ("fingerprint", "abc")}
    out = spark.createDataFrame([("e/b.txt",)], "path string")
    assert {r.path for r in readers.directory(spark, str(tmp_path / "d")).collect()} == {"a.txt", "e/b.txt"}
    assert {r.path for r in readers.directory(spark, str(tmp_path / "d"), exclude=out).collect()} == {"a.txt"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "9.5.2._20210504.txt").write_text("text\nmore")
    assert [tuple(r) for r in readers.text_snapshots(spark, str(tmp_path / "s")).collect()] == [("9.5.2.", "2021-05-04", None, "text\nmore")]
    assert readers.or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_newest_file(spark):
    rows = spark.createDataFrame([("k", "1.2._20200101.pdf, 1.2._20210101_001.pdf,1.2._20210101_002.pdf,x"), ("k2", None), ("k3", "1.2._20190101.pdf,3._20180101.pdf")], "key string, files string")
    got = {tuple(r) for r in readers.latest_files(rows, "key", "files").collect()}
    assert got == {("k", "1.2.", "1.2._20210101_002.pdf", "2021-01-01"), ("k3", "1.2.", "1.2._20190101.pdf", "2019-01-01"), ("k3", "3.", "3._20180101.pdf", "2018-01-01")}


def test_gates_guard_promotion(spark, tmp_path):
    staging, live = str(tmp_path / "staging"), str(tmp_path / "live")
    good = publish.stage(spark.range(10).withColumnRenamed("id", "k"), staging, "t")
    rules = [gates.at_least(1, "rows", "t", 5), gates.unique(2, "keys", "t", "k"), gates.none(3, "no nine", "t", F.col("k") == 9)]
    report = gates.run(rules, {"t": good})
    with pytest.raises(publish.GateFailure, match="3 no nine: 1 bad rows"):
        publish.promote(spark, staging, live, ["t"], report)
    assert not (tmp_path / "live").exists()
    publish.promote(spark, staging, live, ["t"], gates.run(rules, {"t": good}, override=(3,)))
    assert spark.read.parquet(f"{live}/t").count() == 10
    again = publish.stage(spark.range(20).withColumnRenamed("id", "k"), staging, "t")
    publish.promote(spark, staging, live, ["t"], gates.run(rules[:1], {"t": again}))
    assert spark.read.parquet(f"{live}/t").count() == 20


def test_shards_and_chapters(spark, tmp_path):
    p = spark.createDataFrame([("A B", 1), ("C/D", 2)], "inn string, code int")
    publish.write_shards(p, "inn", str(tmp_path / "p"))
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"A_B", "C_D"}
    with pytest.raises(ValueError, match="share"):
        publish.write_shards(spark.createDataFrame([("A B", 1), ("A_B", 2)], "inn string, code int"), "inn", str(tmp_path / "q"))
    publish.write_chapters(spark.createDataFrame([("13.10.",), ("13.2.",), ("2.",)], "code string"), "code", str(tmp_path / "c"))
    assert [r.code for r in spark.read.parquet(str(tmp_path / "c")).where("chapter = 13").collect()] == ["13.2.", "13.10."]


def test_status_rules(spark):
    rows = [("a", "2020-01-01", None, 1), ("a", "2030-01-01", None, 2), ("b", "2010-01-01", "2011-01-01", 3), ("c", "2030-01-01", None, 4), ("d", None, None, 5), ("d", "2019-01-01", "2029-01-01", 6)]
    df = spark.createDataFrame(rows, "k string, s string, e string, o int")
    got = {r.k: (r.status, r.current and r.current.o, r.upcoming and r.upcoming.o, [h.o for h in r.history]) for r in temporal.resolve_status(df, "k", "s", "e", "o", "2024-01-01", ["o"]).collect()}
    assert got == {"a": ("active", 1, 2, [2]), "b": ("delisted", 3, None, [3]), "c": ("upcoming", None, 4, [4]), "d": ("active", 6, None, [5])}


def test_greedy_cover(spark):
    sets = {"a": {1, 2, 3}, "b": {3, 4}, "c": {4, 5, 6, 7}, "d": {7}}
    df = spark.createDataFrame([(k, e) for k, v in sets.items() for e in v], "name string, e int")
    assert aggregates.set_cover(df, "name", "e") == ["c", "a"]


def test_manifest_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("x", "f1", "2020-01-01", "s1", "t1", 1, False), ("x", "f1", "2020-01-01", "s2", "t2", 2, False), ("x", "f2", "2020-02-01", "s3", "t3", 3, False), ("y", "f", "2020-01-01", None, "t1", 4, True)]
    schema = "code string, file string, effective string, sha string, seen string, ordinal int, failed boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(str(src / "b"))
    stream = spark.readStream.schema(schema).json(str(src / "b"))
    q = manifest.manifest_events(stream).writeStream.format("memory").queryName("manifest_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.code, r.kind, r.file, r.prev_file) for r in spark.sql("select * from manifest_events order by code, first_seen, kind desc").collect()]
    assert sorted(got, key=str) == sorted([("x", "new", "f1", None), ("x", "silent_edit", "f1", None), ("x", "revised", "f2", "f1"), ("y", "fetch_failed", None, None)], key=str)
