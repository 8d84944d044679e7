import random

import pytest

from ledgerglass.llm import common


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, 0])
def test_components(spark, monkeypatch, limit):
    """As by union-find: a chain, a hub, a random graph, double and reversed edges; with and without a broadcast."""
    by_size = common.join_by_size
    monkeypatch.setattr(common, "join_by_size", lambda *a: by_size(*a, limit=limit))
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(80)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(400, 401), (401, 400), (400, 401)]
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = sorted((x.node, x.component) for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == sorted((i, find(i)) for i in {x for a, b in edges for x in (a, b) if a != b})
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_take_one_round(spark, monkeypatch):
    writes = []
    write = common.written
    monkeypatch.setattr(common, "written", lambda df, name: (writes.append(name), write(df, name))[1])
    assert common.components(spark.createDataFrame([(1, 2), (1, 3), (7, 9)], "a long, b long")).count() == 5
    assert len(writes) == 2  # the edges, and the round that changes none
