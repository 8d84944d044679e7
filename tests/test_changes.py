"""Change trees, lazy covers, pruned chapters, locale order and the stateful manifest."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerglass.operators import aggregates, change_tree, cover, details, search
from ledgerglass.sources import publish
from ledgerglass.streaming import manifest, watch


def metric(df, name):
    """A metric of the file scans of a plan that has run, summed."""
    plan = df._jdf.queryExecution().executedPlan()
    total, open_ = 0, [plan]
    while open_:
        p = open_.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            open_.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            open_.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "FileSourceScanExec" and p.metrics().contains(name):
            total += p.metrics().apply(name).value()
        children = p.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return total


# --- change trees


def stored(spark, tmp_path, name, rows, schema, cuts, key="k"):
    path = f"file://{tmp_path}/{name}"
    change_tree.store(spark.createDataFrame(rows, schema), key, path, cuts)
    return path


@pytest.mark.parametrize("kind", ["long", "string"])
def test_leaves_are_ranges(spark, kind):
    r = random.Random(1)
    keys = [r.randint(-500, 500) for _ in range(400)]
    shown = (lambda k: k) if kind == "long" else (lambda k: None if k is None else f"k{k + 600:05d}")
    for n in (1, 3, 200):
        cuts = sorted({shown(k) for k in r.sample(keys, n)})
        df = spark.createDataFrame([(shown(k),) for k in [*keys, None]], f"k {kind}")
        got = {x.k: x.leaf for x in df.withColumn("leaf", change_tree.leaf_of(F.col("k"), cuts)).collect()}
        assert all(leaf == (0 if k is None else sum(c <= k for c in cuts)) for k, leaf in got.items())


def test_changes_against_sets(spark, tmp_path):
    """Changed, added, removed and repeated rows, null keys and values; the tree has several levels."""
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b|", None]), r.choice(["|b", "c", None]), r.random()) for i in range(600)] + [(None, "n", None, 0.0), (7, "twice", "x", 1.0)]
    new = [x for x in rows if x[0] is None or x[0] % 50 != 3]
    new = [(k, "z" if k == 100 else a, None if k in (100, 101) else b, v + 1 if k == 102 else v) for k, a, b, v in new] + [(1000, "new", None, None), (7, "twice", "x", 1.0)]
    new = [(k, "N", b, v) if k is None else (k, a, b, v) for k, a, b, v in new]
    schema = "k long, a string, b string, v double"
    cuts = change_tree.ranges(spark.createDataFrame(rows, schema), "k", 300)
    old_path, new_path = stored(spark, tmp_path, "old", rows, schema, cuts), stored(spark, tmp_path, "new", new, schema, cuts)
    got = {x.k: (x.kind, tuple(x.columns)) for x in change_tree.changes(spark, old_path, new_path, "k").collect()}
    want = {}
    for k in {x[0] for x in rows + new}:
        a, b = ([x[1:] for x in t if x[0] == k] for t in (rows, new))
        if not a or not b:
            want[k] = ("removed" if a else "added", ())
        elif changed := tuple(c for i, c in enumerate("abv") if sorted(map(str, (x[i] for x in a))) != sorted(map(str, (x[i] for x in b)))):
            want[k] = ("changed", changed)
    assert got == want and {"added", "removed", "changed"} == {v[0] for v in want.values()} and None in want
    assert change_tree.changes(spark, old_path, old_path, "k").count() == 0


def test_equal_ranges_are_not_read(spark, tmp_path):
    rows = [(i, i % 7) for i in range(4000)]
    cuts = list(range(10, 4000, 10))  # 400 ranges, three levels
    old = stored(spark, tmp_path, "old", rows, "k long, v int", cuts)
    new = stored(spark, tmp_path, "new", [(k, v + (k == 1234)) for k, v in rows if k != 1236], "k long, v int", cuts)
    leaves, compared = change_tree.differing_leaves(spark, old, new)
    assert leaves == [123] and compared <= 1 + 2 * 16 + 16
    out = change_tree.changes(spark, old, new, "k")
    assert sorted((x.k, x.kind) for x in out.collect()) == [(1234, "changed"), (1236, "removed")]
    assert metric(out, "numOutputRows") == 10 + 9
    assert change_tree.differing_leaves(spark, old, old) == ([], 1)


def test_trees_of_other_ranges_and_empty_tables(spark, tmp_path):
    a = stored(spark, tmp_path, "a", [(i, "x") for i in range(20)], "k long, v string", [5, 10])
    b = stored(spark, tmp_path, "b", [(i, "x") for i in range(20)], "k long, v string", list(range(1, 20)))
    none = stored(spark, tmp_path, "none", [], "k long, v string", [5, 10])
    with pytest.raises(ValueError, match="ranges"):
        change_tree.differing_leaves(spark, a, b)
    assert change_tree.ranges(spark.createDataFrame([], "k long"), "k") == []
    with pytest.raises(ValueError, match="leaf"):
        stored(spark, tmp_path, "c", [(1, 2)], "k long, leaf int", [])
    assert change_tree.differing_leaves(spark, a, none)[0] == [0, 1, 2]


# --- covers


def plain_cover(sets):
    missing, out = set().union(*sets.values()) if sets else set(), []
    while missing:
        best = min(sets, key=lambda n: (-len(sets[n] & missing), n))
        out.append((len(out) + 1, best, len(sets[best] & missing)))
        missing -= sets[best]
    return out


@pytest.mark.parametrize("batch, elements", [(4096, 200_000), (3, 200_000), (50, 12), (2, 1)])
def test_lazy_cover_is_the_greedy_one(spark, batch, elements):
    """All at once, a few sets a round, a few elements a round, and sets that are too large to be looked at."""
    r = random.Random(batch)
    n = 40 if batch > 10 else 14
    sets = {f"s{i:02d}": {r.randint(0, 45) for _ in range(r.choice([1, 4, 9]))} for i in range(n)}
    rows = [(s, e) for s, es in sets.items() for e in es] + [("s00", min(sets["s00"]))] * 2 + [(None, 99), ("s01", None)]
    got = [tuple(x) for x in cover.lazy_cover(spark.createDataFrame(rows, "s string, e int"), "s", "e", batch, elements).orderBy("place").collect()]
    assert got == plain_cover(sets)


def test_lazy_cover_as_rounds_of_one(spark):
    sets = {"a": {1, 2, 3}, "b": {3, 4}, "c": {4, 5, 6, 7}, "d": {7}}
    df = spark.createDataFrame([(k, e) for k, v in sets.items() for e in v], "name string, e int")
    assert [x["name"] for x in cover.lazy_cover(df, "name", "e").orderBy("place").collect()] == aggregates.set_cover(df, "name", "e")
    assert cover.lazy_cover(df.limit(0), "name", "e").count() == 0


# --- details


def test_only_wanted_chapters_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/chapters"
    publish.write_chapters(spark.createDataFrame([(f"{c}.{i}.", f"title {c} {i}") for c in range(1, 21) for i in range(30)], "code string, title string"), "code", path)
    wanted = spark.createDataFrame([("3.4.",), ("3.4.",), ("7.1.",), ("99.1.",), ("7.77.",), (None,), ("",)], "code string")
    pending = spark.createDataFrame([("7.1.", "2026-09-01", "later"), ("7.1.", "2026-08-01", "first"), ("8.1.", "2026-01-01", "unseen"), (None, "2026-01-01", "x")], "code string, announced string, notice string")
    out = details.detail_view(spark, path, wanted, "code", pending)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {x.code: (x.title, [tuple(p) for p in x.pending]) for x in out.collect()}
    assert got == {"3.4.": ("title 3 4", []), "7.1.": ("title 7 1", [("2026-08-01", "first"), ("2026-09-01", "later")])}
    assert metric(out, "numPartitions") == 2 and metric(out, "numOutputRows") < 3 * 30 + 20
    assert [x.pending for x in details.detail_view(spark, path, wanted).where("code = '3.4.'").collect()] == [[]]


def test_locale_order(spark):
    names = ["z", "é", "eb", "B", "a", "A", "b", "中", "10", "9", "Ä", "ea"]
    w = F.row_number().over(search.by_locale("n"))
    assert [x.n for x in spark.createDataFrame([(n,) for n in names], "n string").withColumn("p", w).orderBy("p").collect()] == ["10", "9", "a", "A", "Ä", "b", "B", "é", "ea", "eb", "z", "中"]


# --- the manifest with state


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def fetch(code, n, file, sha, effective="2024-01-01", ordinal=0, failed=False):
    return (code, file, effective, sha, str(day(n).date()), ordinal, failed, day(n))


SCHEMA = "code string, file string, effective string, sha string, seen string, ordinal int, failed boolean, at timestamp"


def test_manifest_survives_restarts(spark, tmp_path):
    """Three runs of one stream: what came before is known, timers of before fire, and a later look moves them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watch.PROVIDER)
    source, checkpoint, out = (f"{tmp_path}/{x}" for x in ("in", "checkpoint", "out"))
    runs = [
        [fetch("a", 0, "f1", "s1"), fetch("a", 0, "f1", "s2", ordinal=1), fetch("b", 0, "g1", "t1"), fetch("c", 0, "h1", None, failed=True), fetch("d", 1, "i1", None)],
        [fetch("a", 20, "f2", "s3", "2024-02-01"), fetch("c", 20, "h1", "u1"), fetch("d", 20, "i1", "v", failed=True)],
        [fetch("a", 45, "f0", "s0", "2023-01-01"), fetch("e", 45, "k", "w"), fetch("b", 45, "g1", "t1")],
    ]
    rows = []
    for run in runs:
        spark.createDataFrame(run, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = watch.manifest_watch(spark.readStream.schema(SCHEMA).parquet(source), 30)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        done = spark.read.schema(watch.OUT).parquet(out).collect()
        rows.append(sorted((x.code, x.kind, x.file, x.last_verified.date() if x.last_verified else None) for x in done))
    on = lambda n: day(n).date()
    first = [("a", "new", "f1", on(0)), ("a", "silent_edit", "f1", on(0)), ("b", "new", "g1", on(0)), ("c", "fetch_failed", None, None), ("d", "new", "i1", on(1))]
    second = [("a", "revised", "f2", on(20)), ("c", "new", "h1", on(20)), ("d", "fetch_stale", "i1", on(20))]
    assert sorted(rows[0], key=str) == sorted(first, key=str)
    assert sorted(rows[1], key=str) == sorted(first + second, key=str)
    # day 45 has passed day 0 + 30 for b, which is looked at in the same run and so is not stale; c and d are due on day 50
    assert sorted(rows[2], key=str) == sorted([*first, *second, ("e", "new", "k", on(45))], key=str)
    state = {x.code: (x.file, x.effective, x.prev_file, x.last_verified.date(), x.n_events) for x in watch.manifest_rows(spark, checkpoint).collect()}
    assert state == {"a": ("f2", "2024-02-01", "f1", on(45), 3), "b": ("g1", "2024-01-01", None, on(45), 1), "c": ("h1", "2024-01-01", None, on(20), 1), "d": ("i1", "2024-01-01", None, on(20), 2), "e": ("k", "2024-01-01", None, on(45), 1)}
    # the same rows by the batch rules, one after another
    by_code = {}
    for code, file, effective, sha, seen, _, failed, _ in sorted((x for run in runs for x in run), key=lambda x: (x[7], x[5])):
        by_code[code] = manifest.transition(by_code.get(code), file, effective, sha, seen, failed)[1]
    assert {c: (s[0], s[1], s[4]) for c, s in by_code.items() if s} == {c: x[:3] for c, x in state.items()}
    # time goes on: everything but the newest look is due
    spark.createDataFrame([fetch("z", 80, "last", "x")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = watch.manifest_watch(spark.readStream.schema(SCHEMA).parquet(source), 30)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    stale = sorted((x.code, x.last_verified.date()) for x in spark.read.schema(watch.OUT).parquet(out).where("kind = 'stale'").collect())
    assert stale == [("a", on(45)), ("b", on(45)), ("c", on(20)), ("d", on(20)), ("e", on(45))]
    kinds = {}
    for x in watch.history_rows(spark, checkpoint).collect():
        kinds.setdefault(x.code, []).append(x.kind)
    assert {c: sorted(k) for c, k in kinds.items()} == {"a": ["new", "revised", "silent_edit", "stale"], "b": ["new", "stale"], "c": ["fetch_failed", "new", "stale"], "d": ["fetch_stale", "new", "stale"], "e": ["new", "stale"], "z": ["new"]}
