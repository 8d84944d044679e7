import random
import re
from collections import Counter
from math import floor, log

import numpy as np

from ledgerglass.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, b, size in bags:
            m = 50 + (50 * size * n) // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in q if t in b)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def make(seed, n=400):
    r = random.Random(seed)
    vocabulary = ["ab", "Cd", "é9", "x-y", "zz", "The", "rare%d"]
    text = lambda n: " ".join(w.replace("%d", str(r.randint(0, 99))) for w in r.choices(vocabulary, k=n))
    docs = [(i, text(r.randint(1, 30))) for i in range(n)]
    docs += [(1000 + i, "zz the ab") for i in range(120)]  # ties
    docs += [(7, "zz again"), (7, "zz again"), (None, "the zz ab"), (None, None), (5000, None), (5001, ""), (5002, "!!"), (5003, "ab " * 30_000)]
    items = [(i, text(r.randint(1, 8))) for i in range(20)] + [(50, None), (51, "..."), (52, "zz"), (52, "rare5"), (53, "nowhere"), (None, "zz"), (54, "ZZ zz the")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    """Ties, repeated and null ids, null and empty texts, a very long one, items that share an id."""
    docs, items = make(1)
    d, i = frames(spark, docs, items)
    assert result(rs.digest(d, i)) == brute(docs, items, 50)
    assert result(rs.digest(d, i, 3)) == brute(docs, items, 3)


def test_many_shards_and_blocks(spark, monkeypatch):
    """Shards of a few postings, a block for every few terms, and candidates that are cut while a task goes on."""
    docs, items = make(2, 150)
    d, i = frames(spark, docs, items)
    want = brute(docs, items, 5)
    index = None
    for name, value in (("SHARD_POSTINGS", 40), ("BLOCK_TERMS", 20), ("HELD", 50)):
        monkeypatch.setattr(rs, name, value)
    monkeypatch.setattr("ledgerglass.llm.bytescan.BLOCK", 300)
    index = rs.build_index(d)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert result(rs.search(index, i, 5)) == want
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert index.corpus == (sum(1 for x in docs if terms(x[1])), sum(len(terms(x[1])) for x in docs))


def test_index_is_kept_and_holds_every_posting(spark, tmp_path):
    docs, items = make(3, 50)
    d, i = frames(spark, docs, items)
    index = rs.build_index(d, path=f"file://{tmp_path}/index")
    postings = 0
    for r in spark.read.parquet(f"file://{tmp_path}/index").collect():
        starts, at = np.frombuffer(r["terms"], np.int64), np.frombuffer(r["starts"], np.int32)
        assert (np.diff(starts) > 0).all() and len(at) == len(starts) + 1
        assert at[-1] * 4 == len(r["docs"]) == len(r["impacts"])
        assert [x for x in r["ids"] if x is not None] == sorted(x for x in r["ids"] if x is not None)
        postings += int(at[-1])
    assert postings == sum(len(set(terms(t))) for _, t in docs)
    assert result(rs.search(index, i)) == brute(docs, items, 50)


def test_best_keeps_the_first_of_equals():
    r = np.random.default_rng(1)
    for _ in range(200):
        scores = r.integers(0, 5, 60)
        k = int(r.integers(1, 70))
        want = [i for i in np.lexsort((np.arange(60), -scores)) if scores[i] > 0][:k]
        assert sorted(rs.best(scores, k)) == sorted(want)


def test_empty_tables_string_ids_and_clashing_columns(spark):
    docs, items = make(4, 30)
    d, i = frames(spark, docs, items)
    assert rs.digest(d.limit(0), i).count() == 0
    assert rs.digest(d, i.limit(0)).count() == 0
    assert rs.digest(d.where("text IS NULL"), i).count() == 0
    named = [(None if x is None else f"d{x:05d}", t, "c", 1, None) for x, t in docs]
    d = spark.createDataFrame(named, "doc_id string, text string, id string, score int, terms string")
    i = spark.createDataFrame([(f"i{x}", t, 1) for x, t in items], "item_id string, text string, rank int")
    # null ids come last in the order of strings, as they do in that of numbers
    want = {(f"i{a}", b, None if c is None else f"d{c:05d}", s) for a, b, c, s in brute(docs, items, 50)}
    assert {tuple(r) for r in rs.digest(d, i).collect()} == want
