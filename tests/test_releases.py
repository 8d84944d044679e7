"""All-or-none releases: crashes at every step, conflicts, pinned readers, rollback, history."""

import pytest
from pyspark.sql import functions as F

from ledgerglass.operators import gates
from ledgerglass.sources import publish, releases


def two(spark, n):
    return {"a": spark.range(n).withColumnRenamed("id", "k"), "b": spark.range(2 * n).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part"))}


def seen(spark, root):
    r = releases.current(spark, root)
    return r and (r.number, {t: r.table(t).count() for t in r.tables})


def root_of(tmp_path):
    return f"file://{tmp_path}/release"


@pytest.mark.parametrize("step", ["_write_table 1", "_write_table 2", "_write_report 1", "_write_entry 1", "_switch 1"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_crash_at_any_step_leaves_a_whole_release(spark, tmp_path, monkeypatch, step, when):
    root = root_of(tmp_path)
    releases.publish(spark, root, two(spark, 3))
    name, at = step.split()
    real, calls = getattr(releases, name), []

    def crash(*args):
        calls.append(1)
        if len(calls) < int(at):
            return real(*args)
        if when == "after":
            real(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(releases, name, crash)
    with pytest.raises(KeyboardInterrupt):
        releases.publish(spark, root, two(spark, 5), [gates.at_least(1, "rows", "a", 1)])
    monkeypatch.undo()
    # after the switch the new release is current and whole; before it the old one is
    switched = step == "_switch 1" and when == "after"
    assert seen(spark, root) == ((2, {"a": 5, "b": 10}) if switched else (1, {"a": 3, "b": 6}))
    again = releases.publish(spark, root, two(spark, 7))
    assert (again.number, seen(spark, root)) == (3 if switched else 2, (3 if switched else 2, {"a": 7, "b": 14}))


def test_failed_gates_change_nothing(spark, tmp_path):
    root = root_of(tmp_path)
    rules = [gates.at_least(1, "rows", "a", 4), gates.unique(2, "keys", "b", "k")]
    with pytest.raises(publish.GateFailure, match="1 rows"):
        releases.publish(spark, root, two(spark, 3), rules)
    assert releases.current(spark, root) is None and releases.history(spark, root).count() == 0
    r = releases.publish(spark, root, two(spark, 3), rules, override=(1,))
    assert [tuple(x) for x in releases.history(spark, root).select("table", "overridden").orderBy("table").collect()] == [("a", [1]), ("b", [1])]
    assert {x.id: x.passed for x in r.gates().collect()} == {1: False, 2: True}


def test_only_one_of_two_publishers_wins(spark, tmp_path):
    root = root_of(tmp_path)
    releases.publish(spark, root, two(spark, 3))
    releases.publish(spark, root, two(spark, 4), base=1)
    with pytest.raises(releases.ReleaseConflict):
        releases.publish(spark, root, two(spark, 5), base=1)
    assert seen(spark, root) == (2, {"a": 4, "b": 8})
    assert not list((tmp_path / "release" / "log").glob(".*.tmp"))


def test_pinned_readers_rollback_and_expiry(spark, tmp_path):
    root = root_of(tmp_path)
    first = releases.publish(spark, root, two(spark, 3), partition_by={"b": ["part"]})
    rows = first.table("b")
    for n in (4, 5):
        releases.publish(spark, root, two(spark, n))
    assert rows.count() == 6 and rows.where("part = 1").count() == 2
    back = releases.rollback(spark, root, 1)
    assert (back.number, seen(spark, root)) == (4, (4, {"a": 3, "b": 6}))
    assert releases.expire(spark, root, keep=2) == [releases.current(spark, root, 2).version]
    assert seen(spark, root) == (4, {"a": 3, "b": 6}) and rows.count() == 6
    with pytest.raises(KeyError, match="removed"):
        releases.rollback(spark, root, 2)
    with pytest.raises(KeyError, match="no release 9"):
        releases.rollback(spark, root, 9)
    (tmp_path / "release" / "versions" / "staged-by-somebody").mkdir()
    assert releases.expire(spark, root) == []
    assert [(r.number, r.table, r.n_rows, r.change) for r in releases.history(spark, root).where("table = 'a'").orderBy("number").collect()] == [(1, "a", 3, None), (2, "a", 4, 1), (3, "a", 5, 1), (4, "a", 3, -2)]


def test_drift_from_the_history(spark, tmp_path):
    root = root_of(tmp_path)
    assert releases.drift_gates(spark, root) == []
    releases.publish(spark, root, two(spark, 100))
    releases.publish(spark, root, two(spark, 105), releases.drift_gates(spark, root))
    with pytest.raises(publish.GateFailure, match="a drift: 150 rows, 105 before"):
        releases.publish(spark, root, two(spark, 150), releases.drift_gates(spark, root))
    assert seen(spark, root)[0] == 2


def test_names_and_empty_tables(spark, tmp_path):
    root = root_of(tmp_path)
    with pytest.raises(ValueError):
        releases.publish(spark, root, {"_gates": spark.range(1)})
    r = releases.publish(spark, root, {"none": spark.range(0)})
    assert r.table("none").count() == 0 and r.tables == {"none": 0}
    with pytest.raises(KeyError):
        r.table("other")
