import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerglass.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, budget=1.5, most=2.0):
    """Share by weight, cap, share the excess among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = budget * sum(sizes.values())
    capped = {}
    while True:
        left = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] >= most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}
        if len(capped) == len(names):
            return capped


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 40))), r.choice(["a", "b", "ç", "Z", "d", None])) for i in range(600)]
    return rows + [(700, None, "a"), (701, "", "empty"), (702, " \t\n\x0b ", "a"), (703, "x y　z\x1f", "b"), (703, "x y　z\x1f", "b"), (None, "p q", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_sizes(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.plan(docs).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = targets(size)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in ((math.floor(rate), math.ceil(rate)) if r.size else (0,)) and r.taken == r.size * r.copies <= 2 * r.size
    assert Counter(r.size for r in out) == Counter(len(WORD.findall(t or "")) for _, t, _ in rows)
    taken = defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.25 * max(t, 1)
    assert sorted(map(str, out)) == sorted(map(str, mixing.plan(docs.repartition(2)).collect()))


def test_emission(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.emit(docs)
    assert out.columns == [*docs.columns, "mix_copy"]
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixing.emit(docs.limit(0)).count() == 0 and mixing.digest(docs.limit(0)).count() == 0
