import hashlib
import random
import re

from ledgerglass.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window):
    split = lambda t: WORD.findall((t or "").translate(LOW))
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if x := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def make(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["ab", "Cd", "é9", "x-y", "zz", "the"]) + r.choice(["", "", "q", "."]) for _ in range(n))
    items = [(1, text(30)), (2, text(10)), (10, "Solo"), (11, text(4)), (3, None), (4, "..."), (5, text(12)), (6, text(12)), (5, text(12))]
    docs = [(0, None), (1, ""), (2, "solo"), (3, text(3))]
    for i in range(60):
        t = text(r.randint(1, 80))
        if i % 3 == 0:
            w = items[r.choice([0, 1, 6, 7])][1].split()
            t += " " + " ".join(w[r.randint(0, 4) :]) + " " + text(5)
        docs.append((10 + i, t))
    return docs, items


def test_against_brute_force(spark):
    for seed, window in ((1, 10), (2, 4)):
        docs, items = make(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        i = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: tuple(r)[1:] for r in dc.digest(d, i, window).collect()}
        assert got == brute(docs, items, window)


def test_without_broadcast(spark, monkeypatch):
    docs, items = make(3)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    monkeypatch.setattr("ledgerglass.llm.common.BROADCAST_BYTES", -1)
    assert {r.doc_id: tuple(r)[1:] for r in dc.digest(d, i).collect()} == brute(docs, items, 10)


def test_removal_and_empty_tables(spark):
    docs, items = make(4)
    d = spark.createDataFrame([(*x, "t1", 5) for x in docs], "doc_id long, text string, t1 string, hits int")
    i = spark.createDataFrame(items, "item_id long, text string")
    left = {tuple(r) for r in dc.remove_contaminated(d, i).collect()}
    clean = {k for k, v in brute(docs, items, 10).items() if not v[-1]}
    assert left == {(*x, "t1", 5) for x in docs if x[0] in clean}
    assert dc.digest(d, i.limit(0)).where("contaminated").count() == 0
    assert dc.digest(d.limit(0), i).count() == 0
