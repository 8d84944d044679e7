import numpy as np
import pytest

from ledgerglass.llm import embedding_dedup as ed


def brute(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], dtype=float) if v else np.zeros(1)
        if np.isfinite(x).all() and x.any():
            good[i] = x / np.linalg.norm(x)
    near = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold] for i in good}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen))
    return out


def vectors():
    r = np.random.default_rng(3)
    f = lambda x: [float(np.float32(v)) for v in x]
    rows, k = [], 0
    for size in (60, 20, 5, 3, 2, 2, 2, 2):
        center = r.normal(size=32)
        for _ in range(size):
            rows.append((k, f(center + r.normal(size=32) * 0.15)))
            k += 1
    for _ in range(200):
        rows.append((k, f(r.normal(size=32))))
        k += 1
    same = rows[5][1]
    rows += [(k + i, same) for i in range(30)]
    k += 30
    rows += [(k, None), (k + 1, [0.0] * 32), (k + 2, [float("nan")] * 32), (k + 3, [None, *[1.0] * 31]), (k + 4, []), (k + 5, same[:4]), (k + 6, [2 * x for x in same]), (k + 7, [float("inf")] * 32)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK_VECTORS", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.digest(df).collect()}
    assert got == brute(rows)


def test_links_between_tight_clusters(spark):
    """Every list is full of a vector's own cluster; the links to the cluster beside it count all the same."""
    r = np.random.default_rng(7)
    rows = []
    for _ in range(3):
        a, b = np.linalg.qr(r.normal(size=(32, 2)))[0].T
        for center in (a, 0.935 * a + np.sqrt(1 - 0.935**2) * b):
            rows += [[float(np.float32(v)) for v in center + r.normal(size=32) * 0.014] for _ in range(60)]
    rows = list(enumerate(rows))
    got = {x.vec_id: (x.n_links, x.component_id) for x in ed.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert got == brute(rows)
    assert set(n for n, _ in got.values()) == {119}


def test_audit_counts_nodes_not_links():
    assert ed.recall([]) == ed.recall([(0, 0), (5, 5)]) == 1.0
    assert ed.recall([(1000, 1000)] + [(0, 1)] * 9) == 0.1
    assert ed.recall([(1, 1)] * 80 + [(0, 100)] * 4 + [(100, 100)] * 16) == 0.8


def test_empty(spark):
    assert ed.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("tile", [ed.TILE, (8, 16)])
def test_exact_finds_what_the_rounds_miss(spark, monkeypatch, tile):
    """Pairs just above the threshold with no other neighbour; the rounds start with one table and stop at once."""
    monkeypatch.setattr(ed, "TILE", tile)
    r = np.random.default_rng(11)
    x = r.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    rows = list(enumerate([*x.tolist(), *(0.902 * x + np.sqrt(1 - 0.902**2) * y).tolist(), *r.normal(size=(10, 8)).tolist()]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    marked = lambda **how: {v.vec_id: (v.n_links, v.component_id) for v in ed.link(df, target=0.0, tables=1, length=2, **how).collect()}
    assert marked(exact=True) == brute(rows)
    assert marked() != brute(rows)


def test_exact_compares_blocks_and_searches_nothing(spark, monkeypatch):
    """The search shuffles each vector about a hundred times; a comparison of all nodes has no use for what it finds."""
    monkeypatch.setattr(ed, "neighbour_graph", lambda *x: pytest.fail("it searches"))
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for size in (ed.BLOCK_BYTES, 6000):
        monkeypatch.setattr(ed, "BLOCK_BYTES", size)
        got = {r.vec_id: (r.n_links, r.component_id) for r in ed.digest(df, exact=True).collect()}
        assert got == brute(rows)


def test_exact_where_most_blocks_are_empty(spark):
    """A block without a partner is not compared with itself once more; pairs at the threshold's edge are decided in double precision."""
    near = lambda d: [0.9 + d, float(np.sqrt(1 - (0.9 + d) ** 2)), 0.0]
    rows = list(enumerate([[1.0, 0.0, 0.0], near(1e-9), near(-1e-9), [0.0, 0.0, 1.0], [0.0, 0.001, 1.0], [1.0, 0.0], [1.0, 0.1]]))
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=True).collect()}
    assert got == brute(rows)
