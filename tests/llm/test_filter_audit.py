import random
import re
from collections import Counter
from itertools import permutations

from ledgerglass.llm import filter_audit as fa


def flags_of(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        out.append((i, lang or "", {f for f, x in fails.items() if x}))
    return out


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows, shapley = {}, Counter()
    flagged = flags_of(docs)
    for part in {p for _, p, _ in flagged}:
        for order in permutations("ABCDE"):
            alive = [x for x in flagged if x[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                out = [x for x in alive if f in x[2]]
                alive = [x for x in alive if f not in x[2]]
                redundant = sum(f in x[2] for x in gone)
                gone += out
                only = sum(x[2] == {f} for x in flagged if x[1] == part)
                shapley[part, f] += len(out)
                rows[part, "".join(order), step] = [len(alive), len(out), redundant, only, sum(x[0] in good for x in out if x[0] is not None), sum(x[0] in toxic for x in out if x[0] is not None)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def make(seed):
    r = random.Random(seed)
    docs = []
    for i in range(60):
        w = [r.choice(["Ab", "cd", "é", "x", "WORD"]) + (str(r.randint(0, 200)) if r.random() < 0.6 else "") for _ in range(r.choice([5, 150, 199, 200, 230]))]
        docs.append((i, r.choice([" ", "\n", "\t ", "\x0b"]).join(w) + r.choice(["", "", "#", "|"]), r.choice(["en", "de", None, ""])))
    docs += [(100 + i, docs[i % 7][1], "en") for i in range(30)]  # copies, some in another part
    docs += [(200, None, "en"), (201, "", "fr"), (202, None, None), (None, "", "en"), (None, docs[0][1], "en"), (3, docs[3][1], docs[3][2]), (300, "word x " * 50_000, "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    """Null and empty texts and parts, null and repeated ids, copies across parts, labels that repeat or belong to nothing, a very long text."""
    for seed in (1, 2):
        docs, labels = make(seed)
        assert {tuple(r) for r in fa.digest(*frames(spark, docs, labels)).collect()} == brute(docs, labels)


def test_by_shuffle(spark, monkeypatch):
    docs, labels = make(3)
    by_size = fa.join_by_size
    joined = []

    def no_broadcast(big, small, on, how, small_bytes):
        joined.append(small_bytes)
        return by_size(big, small, on, how, small_bytes, -1)

    monkeypatch.setattr(fa, "join_by_size", no_broadcast)
    assert {tuple(r) for r in fa.digest(*frames(spark, docs, labels)).collect()} == brute(docs, labels)
    assert len(joined) == 2


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = make(4)
    d, lab = frames(spark, docs, labels)
    assert fa.digest(d.limit(0), lab).count() == 0
    assert {tuple(r) for r in fa.digest(d, lab.limit(0)).collect()} == brute(docs, [])
    wide = d.selectExpr("*", "1 AS part", "2 AS fails", "'x' AS digest", "3 AS good", "4 AS first")
    assert {tuple(r) for r in fa.digest(wide, lab.selectExpr("*", "1 AS good")).collect()} == brute(docs, labels)


def test_other_filters(spark):
    """Any number of filters up to seven; one row for each permutation and step."""
    flags = spark.createDataFrame([("p", 0, True, False), ("p", 5, False, True), ("p", 7, True, True)], "part string, fails int, good boolean, toxic boolean")
    rows = {(r.filter_order, r.step): tuple(r)[3:] for r in fa.replay(flags, "XYZ").collect()}
    assert len(rows) == 18
    assert rows["XYZ", 1] == (1, 2, 0, 0, 1, 2, 5)
    assert rows["YXZ", 1] == (2, 1, 0, 0, 1, 1, 2)
    assert rows["YXZ", 2] == (1, 1, 1, 0, 0, 1, 5)
