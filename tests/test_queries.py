"""Every registered query against the SQL that DuckDB runs on the same tables."""

import datetime
import glob
import os

import duckdb
import pytest

from ledgerglass.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(names, rows, other_names, other_rows):
    assert sorted(names) == sorted(other_names)
    order = [names.index(n) for n in sorted(names)]
    other = [other_names.index(n) for n in sorted(names)]
    a = sorted(tuple(plain(r[i]) for i in order) for r in rows)
    b = sorted(tuple(plain(r[i]) for i in other) for r in other_rows)
    assert len(a) == len(b)
    assert [x for x in zip(a, b) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name == "search_fuzzy"
    if name in catalogue.ORACLES:
        r = duck.execute(catalogue.ORACLES[name])
        compare(df.columns, rows, [d[0] for d in r.description], r.fetchall())
