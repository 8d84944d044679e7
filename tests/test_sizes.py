"""What decides whether a query gets by with large tables: what goes through the driver, what one task holds, how often a row is worked on."""

import unicodedata
from datetime import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerglass.functions import names as product_names
from ledgerglass.functions import textnorm
from ledgerglass.operators import batch_search, near_names, search, tables
from ledgerglass.operators.search import Field
from ledgerglass.plans import catalogue, releases
from ledgerglass.sources import readers
from ledgerglass.streaming import watch


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_names_send_nothing_through_the_driver(spark):
    names = spark.range(300).selectExpr("id AS key", "concat('Customer#', lpad(id, 9, '0')) AS name")
    for ahead in (False, True):
        found = near_names.near_names(names, "key", "name", names.selectExpr("upper(name) AS term"), "term", ahead=ahead)
        assert "Broadcast" not in final_plan(found)


def test_ranked_search_sends_nothing_through_the_driver(spark):
    entries = spark.range(300).selectExpr("id AS key", "concat('name ', id % 7) AS name")
    fields, terms = [Field("name", "name", 100, 95, 50)], spark.createDataFrame([("name",), ("ame 3",), ("nme 4",)], "term string")
    hits = batch_search.batch_search(entries, "key", "name", fields, terms, "term")
    assert "Broadcast" not in final_plan(hits)
    assert "Broadcast" not in final_plan(batch_search.near_where_none(hits, entries, "key", "name", fields, terms, "term"))


def test_a_form_brings_only_its_first_entries(spark):
    """A form that all entries have is not joined with all of them; primary entries come first, null names before others."""
    entries = spark.range(400).selectExpr("id AS key", "CASE WHEN id % 100 = 99 THEN NULL ELSE concat('e', lpad(400 - id, 3, '0')) END AS name", "array('common', 'common') AS many", "id % 150 = 0 AS first")
    fields = [Field("many", "many", 50, 40, 30, True)]
    values, _ = index = batch_search.build_index(entries, "key", fields)
    names = entries.select("key", "name", F.col("first").alias("primary"))
    assert batch_search._leaders(values, names, "key", 5).select("key").distinct().count() == 5
    got = batch_search.batch_search(entries, "key", "name", fields, spark.createDataFrame([("common",)], "term string"), "term", 5, "first", index).orderBy("rank").collect()
    assert [(r.key, r.score) for r in got] == [(300, 51), (150, 51), (0, 51), (99, 50), (199, 50)]


def worked_out(df, what):
    """How often an expression stands in the plan, and so is worked out for a row."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_names_are_worked_out_once(spark):
    rows = spark.createDataFrame([("aspirin sodium 5 mg", "", "")], "a string, b string, c string")
    vocabulary = product_names.Vocabulary(salts=frozenset({"SODIUM"}), preserve=frozenset({"X"}), esters=frozenset({"Y"}), aliases={"A": "B"})
    assert worked_out(rows.select(product_names.canonicalize("a", vocabulary).alias("k")), "regexp_replace(") <= 12
    n = rows.select(product_names.normalize("a", "b", "c", vocabulary).alias("n")).select("n.keys", "n.combo_key", "n.source", "n.warnings")
    assert worked_out(n, "regexp_replace(") <= 24
    assert [tuple(r) for r in n.collect()] == [(["ASPIRIN"], None, "group", [])]


def test_lines_are_looked_up_only_where_a_known_line_is_as_long():
    class Counted(set):
        asked = 0

        def __contains__(self, x):
            self.asked += 1
            return super().__contains__(x)

    known = Counted({"abcdef", "xy" * 500})
    text = "ab\n c d\nef\n" + "\n".join("z" for _ in range(1000))
    assert tables.rejoin_lines(text, known).split("\n")[:2] == ["ab c d ef", "z"]
    assert known.asked < 1100  # 11 for each line, when every run was


def test_file_names_are_worked_out_once(spark):
    rows = spark.createDataFrame([("9.1._20200101_002.pdf,9.1._20200101_001.pdf, 9.2._20190101.pdf,x",)], "files string")
    found = rows.select(readers.newest_of("files").alias("f"))
    assert worked_out(found, "RLIKE") + worked_out(found, "rlike(") == 1
    assert [tuple(x) for x in found.first().f] == [("9.1.", "2020-01-01", 2), ("9.2.", "2019-01-01", -1)]


def test_fields_are_worked_out_once(spark):
    rows = spark.createDataFrame([("b", ["x", "br y"]), ("c", None)], "name string, kinds array<string>")
    found = search.search(rows, "br", [Field("name", "name", 100, 95, 50), Field("kinds", "kind", 78, 70, 38, True)], limit=None)
    assert worked_out(found, "regexp_replace(") == 2
    assert [(r["name"], r.score, r.field, r.matched) for r in found.collect()] == [("b", 70, "kind", "br y")]


def test_master_files_have_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(releases, "_MASTER_ROWS", 50)
    rows = catalogue.QUERIES["master_csv"](spark, "/root/testdata/sf0.001")
    assert len(rows.inputFiles()) >= 4 and rows.count() == 200


def test_few_texts_are_in_python_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10000)
    catalogue.QUERIES["mojibake"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) <= 1000
    texts = ["a", "é", "e\u0301", "\u212b", "", None, "한글", unicodedata.normalize("NFD", "한글")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(textnorm.is_nfc("t").alias("a"), (textnorm.nfc("t") == F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_a_code_costs_a_few_calls_on_the_state():
    """Twenty fetches of a code: its row is read once and written once, its history gets one list."""
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *x: calls.append(name)

        getValueState = getListState = lambda self, *x: self

    p = watch.ManifestWatch(30)
    p.init(State())
    fetches = [Row(code="a", file=f"f{i}", effective=f"2024-01-{i + 1:02}", sha="s", seen="x", ordinal=0, failed=False, at=datetime(2024, 1, i + 1), at_ms=i * watch.DAY_MS) for i in reversed(range(20))]
    out = list(p.handleInputRows(("a",), iter(fetches), None))
    assert [(r.kind, r.file) for r in out] == [("new", "f0"), *(("revised", f"f{i}") for i in range(1, 20))]
    assert sorted(calls) == ["appendList", "get", "registerTimer", "update"]


def test_values_and_terms_that_repeat_are_not_worked_on_again(spark, monkeypatch):
    """Only the first entries of a value are kept, and only they and different terms go to Python."""
    tables_, plans = {}, {}

    def noted(df, name, written=batch_search.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        out = tables_[name] = written(df, name)
        return out

    monkeypatch.setattr(batch_search, "written", noted)
    entries = spark.range(400).selectExpr("id AS key", "concat('e', lpad(400 - id, 3, '0')) AS name", "'Ｃommon' AS kind")
    hits = batch_search.batch_search(entries, "key", "name", [Field("kind", "kind", 50, 40, 30)], spark.range(400).selectExpr("concat('common', id % 2 - 1) AS term").selectExpr("substr(term, 1, 6) AS term"), "term", 5)
    assert [(r.rank, r.key, r.matched) for r in hits.orderBy("rank").collect()] == [(i + 1, 399 - i, "Ｃommon") for i in range(5)]
    assert {name: t.count() for name, t in tables_.items() if name != "search-postings"} == {"search-first-values": 5, "search-leaders": 5, "search-given": 1, "search-terms": 1, "search-first": 5}
    assert not any("ArrowEvalPython" in plans[name] for name in ("search-first-values", "search-given"))


def test_long_terms_meet_few_values_however_many_begin_alike(spark, monkeypatch):
    """Numbered names have their first half and most short n-grams in common; terms of every length find what a comparison of all finds."""
    met = []

    def noted(rows, fields, matches=batch_search._matches):
        met.append(rows.count())
        return matches(rows, fields)

    monkeypatch.setattr(batch_search, "_matches", noted)
    entries = spark.range(1000).selectExpr("id AS key", "concat('supplier#', lpad(id * 7919, 9, '0'), ' and what it says') AS name")
    names = [(r.key, r.name) for r in entries.collect()]
    fields = [Field("name", "name", 100, 95, 50)]
    whole = [name[i:j] for _, name in names for i, j in ((0, 18), (11, 18), (0, 35))]
    batch_search.batch_search(entries, "key", "name", fields, spark.createDataFrame([(t,) for t in whole], "term string"), "term", 3)
    assert sum(met) < 10 * len(whole)
    terms = sorted({names[41][1][i : i + n] for n in range(1, 36) for i in (0, 7, 35 - n)} - {" "})
    got = batch_search.batch_search(entries, "key", "name", fields, spark.createDataFrame([(t,) for t in terms], "term string"), "term", 3)
    score = lambda t, name: 100 if t == name else 95 if name.startswith(t) else 50 if t in name else 0
    first = lambda t: sorted((-score(t.strip(), name), name, key) for key, name in names if t.strip() in name)[:3]
    assert sorted((r.term, r["rank"], r.key, r.score) for r in got.collect()) == sorted((t, i + 1, key, -s) for t in terms for i, (s, _, key) in enumerate(first(t)))
