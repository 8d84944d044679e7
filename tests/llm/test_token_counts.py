import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerglass.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MERGES = tc.load_merges(PATH)


def library(texts):
    return [len(x) for x in LIBRARY.encode(list(texts), num_threads=1)]


def naive(text, ranks):
    """Byte-pair merging by looking for the lowest pair again and again."""
    symbols = list(text)
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ranks]
        if not found:
            return sum(1 if s in ranks else len(s.encode()) for s in symbols)
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the\n\t\r.,▁<s>中漢é😀\x00"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_as_the_library(text):
    assert tc.Counter(MERGES)(text) == library([text])[0]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=30), st.sets(st.text("abc", min_size=2, max_size=4), max_size=12), st.integers(0, 9))
def test_heap_against_naive_merging(text, pieces, seed):
    """Vocabularies with equal ranks, and with characters that are no pieces."""
    r = random.Random(seed)
    ranks = {p: r.randint(0, 3) for p in sorted(pieces)} | {"a": 9}
    if text:
        assert tc.count_part(text, ranks) == naive(text, ranks)


def test_cutting_changes_nothing():
    """A whole text as one part and cut into parts; pieces that go on behind a space are not cut."""
    r = random.Random(3)
    for _ in range(300):
        t = "▁" + "".join(r.choice(["the", "in", "▁", "▁▁", ",", "(", "\n", "é", "中", "7", "x"]) for _ in range(40))
        assert sum(tc.count_part(p, MERGES.ranks) for p in MERGES.pattern().findall(t)) == tc.count_part(t, MERGES.ranks)
    odd = tc.Merges({"a": 0, "▁": 1, "a▁": 2, "a▁a": 3}, False, "odd")
    assert tc.Counter(odd)("a a\na a") == tc.count_part("a▁a\na▁a", odd.ranks) == naive("a▁a\na▁a", odd.ranks) == 3


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = dict(zip(texts, library(texts.values()), strict=True))
    got = {tuple(r) for r in tc.digest(docs, PATH).collect()}
    assert got == {(i, len(t.encode()), want[i], want[i] > 4096) for i, t in texts.items()}


def test_odd_rows(spark):
    """Nulls, empty and very long texts (with spaces and without), repeated rows, clashing columns, an empty table."""
    long, solid = "many words and more " * 40_000, "añb漢c" * 60_000
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (None, "a b", 5, None), (3, "same", 5, "x"), (3, "same", 5, "x"), (4, long, None, "x"), (5, solid, 5, "x"), (6, "   ", 5, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, __text string")
    got = sorted(tc.digest(d, PATH).collect(), key=str)
    want = dict(zip(range(8), library(r[1] or "" for r in rows), strict=True))
    assert got == sorted([(r[0], len((r[1] or "").encode()), want[i], want[i] > 4096) for i, r in enumerate(rows)], key=str)
    assert tc.digest(d.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tc.token_counts(d, MERGES, keep=("n_tokens",))


def test_forgetting_words(monkeypatch):
    """A memory of a few words counts as one of many."""
    monkeypatch.setattr(tc, "KEPT_WORDS", 8)
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "x" * 80]) for _ in range(50)) for _ in range(40)]
    small = tc.Counter(MERGES)
    assert [small(t) for t in texts] == library(texts)
    assert len(small.known) <= 5 and len(small.older) <= 5
