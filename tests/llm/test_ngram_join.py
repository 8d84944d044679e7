import random
import re

import numpy as np

from ledgerglass.llm import ngram_join as nj
from ledgerglass.llm.common import written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in range(len(sets))}


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    out = [None, "", "...", "Solo", "solo!", "one two three", "One  two, three"]
    line = text(12)
    for i in range(25):
        t = text(r.randint(40, 300))
        out.append(" ".join(t + (line if i % 2 else [])))
        for _ in range(r.choice([0, 0, 1, 3, 6])):
            c = list(t)
            for _ in range(r.randint(0, 5)):
                c[r.randrange(len(c))] = word()
            out.append(" ".join(c))
    base = text(200)
    for _ in range(150):  # one large group of near copies
        c = list(base)
        for _ in range(r.randint(0, 4)):
            c[r.randrange(len(c))] = word()
        out.append(" ".join(c))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 40)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.digest(docs).collect()}
    assert got == brute(texts)


def test_one_of_each_class_stays(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(5, a, "x"), (3, a.upper(), "y"), (3, a.upper(), "y"), (7, a + " end", "z"), (8, None, "n"), (9, "", "n"), (9, "", "n"), (10, "other words here", "o"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key string")
    got = sorted((tuple(r) for r in nj.keep_one(docs).collect()), key=str)
    assert got == sorted([(3, a.upper(), "y"), (8, None, "n"), (9, "", "n"), (9, "", "n"), (10, "other words here", "o"), (None, None, None)], key=str)
    assert nj.digest(docs.limit(0)).count() == 0


def test_pairs_at_the_threshold_share_a_path_at_the_last_depth():
    r = np.random.default_rng(8)
    pairs, runs, found = 1500, nj.runs_for(0.995), 0
    for _ in range(pairs):
        s = r.integers(0, 2**63, 500).astype(np.uint64)
        sig = np.stack([nj.embed(s[:450]), nj.embed(s[50:])])  # 400 of 500 shared
        path, owner = np.tile(nj.mix(np.arange(runs, dtype=nj.U) + nj.U(0x1234567)), 2), np.repeat([0, 1], runs)
        for _ in range(nj.DEPTH):
            path, owner = nj._step(path, owner, sig, 0.8)
        found += len(np.intersect1d(path[owner == 0], path[owner == 1])) > 0
    assert found >= 0.99 * pairs


def test_pieces():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, 30).astype(np.uint64)) for _ in range(9)]
    exact = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    apart = ~np.eye(9, dtype=bool)
    assert (nj._intersections(sets, width=7) == exact)[apart].all()
    assert nj.runs_for(0.995) >= 8
    linked = np.zeros((5, 5), bool)
    for i, j in ((0, 1), (1, 2), (3, 4), (0, 2)):
        linked[i, j] = linked[j, i] = True
    assert len(nj._forest(linked)) == 3


def test_paths_are_shuffled_once(spark):
    """Only paths that sets of different groups share are left, and the count and the rows read one shuffle."""
    rows = [(bytes([i]), path, group) for i, path, group in ((1, 5, 1), (2, 5, 2), (3, 6, 3), (1, 7, 1), (4, 7, 1), (2, 8, 2), (3, 8, 3), (4, 8, 1))]
    df = nj._shared(spark.createDataFrame(rows, "set_key binary, path long, group long").repartition(3))
    got = sorted((r.path, bytes(r.set_key), r.group, r.n, bytes(r.low)) for r in df.collect())
    assert got == [(5, b"\1", 1, 2, b"\1"), (5, b"\2", 2, 2, b"\1"), (8, b"\2", 2, 3, b"\2"), (8, b"\3", 3, 3, b"\2"), (8, b"\4", 1, 3, b"\2")]
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 1


def test_sketches_are_dealt_once_a_call(spark, monkeypatch):
    """Only sets on shared paths are looked up at the levels; links come out of the leaves and of what is large at the last depth."""
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.concatenate([base[i:], r.integers(0, 2**63, i).astype(np.uint64)]) for i in range(12)] + [r.integers(0, 2**63, 300).astype(np.uint64) for _ in range(400)]
    key = lambda i: i.to_bytes(16, "big")
    rows = [(key(i), nj.embed(s).tobytes(), i) for i, s in enumerate(sets)]
    classes = written(spark.createDataFrame(rows, "set_key binary, sig binary, group long").repartition(3), "classes")
    for leaf in (128, 2):  # 2: large down to the last depth
        monkeypatch.setattr(nj, "LEAF", leaf)
        edges, used = nj._candidates(classes, 0.8, range(12))
        known = next(t for t in used if "sig" in t.columns)
        assert 12 <= known.count() < 100
        got = {x for e in edges.collect() for x in (bytes(e.a), bytes(e.b))}
        assert got == {key(i) for i in range(12)}


def test_a_set_is_looked_up_once_a_level(spark, monkeypatch):
    """However many paths near copies share, joins have a row for each set and not for each path."""
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.concatenate([base[i:], r.integers(0, 2**63, i).astype(np.uint64)]) for i in range(60)]
    rows = [(i.to_bytes(16, "big"), nj.embed(s).tobytes(), i) for i, s in enumerate(sets)]
    classes = written(spark.createDataFrame(rows, "set_key binary, sig binary, group long").repartition(3), "classes")
    monkeypatch.setattr(nj, "LEAF", 4)
    inputs, paths = [], nj._paths
    monkeypatch.setattr(nj, "_paths", lambda rows, *a: (inputs.append(rows), paths(rows, *a))[1])
    edges, _ = nj._candidates(classes, 0.8, range(12))
    assert len(inputs) == 3 and all(30 < x.count() <= 60 for x in inputs)
    group = np.arange(60)
    for e in edges.collect():
        a, b = group[int.from_bytes(e.a, "big")], group[int.from_bytes(e.b, "big")]
        group[group == max(a, b)] = min(a, b)
    assert (group[:40] == 0).all()


def test_lookup_shuffles_paths_once(spark):
    rows = [(1, 5, 1), (2, 5, 2), (1, 7, 1), (2, 7, 2), (3, 6, 3), (1, 8, 1), (2, 8, 2), (3, 8, 3)]
    buckets = nj._shared(spark.createDataFrame(rows, "set_key long, path long, group long").repartition(3)).withColumnRenamed("set_key", "number")
    sets = spark.createDataFrame([(i, bytes([i]), b"", i) for i in range(5)], "number long, set_key binary, sig binary, group long")
    df = nj._sharing(sets, buckets, False)
    got = {r.number: (len(r.leaves), r.large) for r in df.collect()}
    assert got == {1: (2, []), 2: (2, []), 3: (1, [])}  # paths 5 and 7 hold the same sets: one look
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 1
