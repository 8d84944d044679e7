"""Wrapping, brands to show, combinations, near misses, and pages that are fetched once."""

import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from ledgerglass.functions import textnorm
from ledgerglass.operators import aggregates, batch_search, search
from ledgerglass.sources import readers


def columns(s):
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


@given(st.text("ab 給付，Ａ\n", max_size=80), st.integers(2, 12))
def test_wrapped_lines_keep_every_character(text, width):
    lines = textnorm.wrapped(text, width).split("\n")
    assert all(columns(x) <= width for x in lines)
    assert "".join(lines) == text.replace("\n", "")
    # a line is only broken where the next character has no place, or where the text breaks
    for a, b in zip(lines, lines[1:]):
        assert not b or columns(a) + columns(b[0]) > width or "\n" in text


def test_wrap(spark):
    rows = [("限皮膚科專科醫師使用",), ("abcdefghij",), ("",), (None,), ("限a\n科",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").coalesce(1).select(textnorm.wrap(6, "> ")("t").alias("x")).collect()]
    assert got == ["限皮膚\n> 科專科\n> 醫師使\n> 用", "abcdef\n> ghij", "", None, "限a\n> 科"]


def test_brand_labels(spark):
    rows = [
        ("g1", "A", "A 甲", True, 5, 1), ("g1", "A", "A 乙", True, 9, 2), ("g1", "B", "B", True, 9, 3), ("g1", "C", "C", True, None, 4), ("g1", "D", "D", True, 0, 5), ("g1", "X", "X", False, 99, 6),
        ("g2", "P", "P", False, 1, 1), ("g2", "", "丙", False, 9, 2),
        ("g3", "", "乙", True, 9, 1), ("g3", None, "丁", False, 1, 2), ("g3", "E", "E", False, 1, 3), ("g3", "", "", False, 1, 4),
        ("g4", "", "戊", None, 1, 1), ("g4", "", "戊", False, 2, 2), ("g4", "", None, False, 2, 3), (None, "N", "N", False, 1, 1),
        ("g5", "", "", True, 1, 1),
    ]
    df = spark.createDataFrame(rows, "g string, en string, label string, originator boolean, price int, ordinal int")
    got = {}
    for r in aggregates.brand_labels(df.where("g is not null"), ["g"]).collect():
        got.setdefault(r.g, []).append((r["rank"], r.label))
    got = {g: [x for _, x in sorted(v)] for g, v in got.items()}
    # originators by price, each once under its best-paid row; others only without originators; labels in order where no name is English
    assert got == {"g1": ["A 乙", "B", "C"], "g2": ["P"], "g3": ["E", "丁"], "g4": ["戊"]}


def test_combinations(spark):
    rows = [(["A", "B"], True, "A + B", "D01", ["1.", "2."]), (["A"], False, "", "D02", ["1."]), (["A", "C"], True, "A + C", None, None), (["B", "A"], True, "A + B", "", []), (None, None, None, "D09", ["9."])]
    df = spark.createDataFrame(rows, "inn_keys array<string>, is_combo boolean, combo_key string, atc string, sections array<string>")
    got = {r.inn: (r.is_combo_member, r.combo_keys, r.atc, r.sections, r.n_products) for r in aggregates.combinations(df).collect()}
    assert got == {"A": (True, ["A + B", "A + C"], ["D01", "D02"], ["1.", "2."], 4), "B": (True, ["A + B"], ["D01"], ["1.", "2."], 2), "C": (True, ["A + C"], [], [], 1)}


def test_near_misses_only_where_nothing_is_found(spark):
    df = spark.createDataFrame([(1, "acyclovir", ["zovirax"]), (2, "famciclovir", ["famvir"]), (3, "Acyclovis", [None, "acyclovirr"])], "k int, name string, aliases array<string>")
    fields = [f for f in search.DRUG_FIELDS if f.column in ("name", "aliases")]
    terms = spark.createDataFrame([(t,) for t in ("acyclovi", "acyclovix", "ZOVIRAXX", "zovi", "famv1r", "xyz", "nothing", None)], "t string")
    hits = batch_search.batch_search(df, "k", "name", fields, terms, "t")
    got = sorted((r.t, r["rank"], r.k, r.score, r.field, r.matched) for r in batch_search.near_where_none(hits, df, "k", "name", fields, terms, "t").collect())
    assert got == [
        ("ZOVIRAXX", 1, 1, 10, "alias", "zovirax"),
        ("acyclovi", 1, 3, 95, "name", "Acyclovis"), ("acyclovi", 2, 1, 95, "name", "acyclovir"),
        ("acyclovix", 1, 3, 10, "name", "Acyclovis"), ("acyclovix", 2, 1, 10, "name", "acyclovir"),
        ("famv1r", 1, 2, 10, "alias", "famvir"), ("zovi", 1, 1, 90, "alias", "zovirax"),
    ]


def test_pages_are_fetched_once(spark, tmp_path):
    def fetch(page, size):
        (tmp_path / f"fetched-{page}").open("a").write("x")
        return [{"k": i} for i in range((page - 1) * size, min(page * size, 25))]

    new = readers.paged(spark, fetch, 25, "k int", 10, "once")
    old = spark.createDataFrame([(-1,)], "k int")
    kept = readers.complete_or(new, 25, old)
    assert sorted(r.k for r in kept.collect()) == list(range(25)) and kept.count() == 25
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {f"fetched-{i}": "x" for i in (1, 2, 3)}
    assert [r.k for r in readers.complete_or(readers.paged(spark, fetch, 25, "k int", 10, "again"), 26, old).collect()] == [-1]
