import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from ledgerglass.llm import suffix_dedup as sd


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, r in enumerate(raws):
        for s in range(len(r) - length + 1):
            places[r[s : s + length]].append((d, s))
    mark = [bytearray(len(r)) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for d, s in found:
                mark[d][s : s + length] = b"\1" * length
    out = []
    for r, m in zip(raws, mark, strict=True):
        kept = bytes(b for b, x in zip(r, m, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        out.append((len(r), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(25)
    out = [None, "", "x", "a" * 900, "ab" * 300, text(100)[:400]]
    for i in range(40):
        t = text(r.randint(1, 150))
        if i % 3 == 0:
            t = text(30) + passage[r.randint(0, 30) :] + t
        if i % 4 == 0:
            t = line + t + line
        out.append(t)
        if i % 7 == 0:
            out.append(t)
        if i % 5 == 0:
            out.append(t[: len(t) // 2] + "#" + t[len(t) // 2 :])
    return out


@pytest.mark.parametrize("batches", [2, 5])
def test_against_brute_force(spark, batches):
    texts = corpus(batches)
    docs = spark.createDataFrame([(i, t, 7, "t") for i, t in enumerate(texts)], "doc_id long, text string, spans int, t1 string").repartition(3)
    for length in (400,) if batches == 2 else (100,):
        passage = max(64, 3 * length // 5)
        got = {r.doc_id: tuple(r)[1:] for r in sd.digest(docs, length, passage, batches).collect()}
        assert got == {i: (*b, p[1]) for i, (b, p) in enumerate(zip(brute(texts, length), brute(texts, passage), strict=True))}


def test_cut_keeps_columns_and_clean_rows(spark):
    rows = [(1, "A" + "é" * 300, 301, "x"), (2, "B" + "é" * 300, 301, None), (None, None, None, "y"), (4, "short", 5, "z"), (5, "q" * 500, 500, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {(r.doc_id, r.text, r.n_chars, r.spans) for r in sd.remove_repeats(docs).collect()}
    assert got == {(1, "A", 1, "x"), (2, "B", 1, None), (None, None, None, "y"), (4, "short", 5, "z")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.digest(docs).count() == 0


def test_all_of_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:-1] for r in sd.digest(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 400), strict=True))


def test_index_in_a_folder_over_calls(spark, tmp_path):
    """Each call brings a batch; the spans of all calls together are those of brute force, and levels merge."""
    folder, length = f"file://{tmp_path}/index", 100
    texts = corpus(9)
    parts = [texts[i::4] for i in range(4)]
    marks = defaultdict(set)
    earlier = None
    for part in parts:
        docs = spark.createDataFrame([(t,) for t in part], "text string")
        index = sd.SuffixIndex(spark, folder)
        for r in sd.extend_index(index, docs, earlier, length).collect():
            marks[r.t1, r.t2] |= {i for s in r.spans for i in range(s.start, s.end)}
        earlier = docs if earlier is None else earlier.union(docs)
    assert [size for size, _ in sd.SuffixIndex(spark, folder).levels] == [2, 1, 1]
    keyed = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", *sd.text_key())
    got = {r.i: len(marks[r.t1, r.t2]) for r in keyed.collect()}
    assert got == {i: b[1] for i, b in enumerate(brute(texts, length))}


def test_clashing_names_and_a_run_of_any_frequency(spark):
    same = "z" * 50 + "0123456789" * 12
    rows = [(i, f"{i} " + same, True, "s") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __cut boolean, repeat_spans string")
    out = sd.remove_repeats(docs, 100)
    assert out.columns == docs.columns
    # a text of which nothing is left is dropped
    assert {r.doc_id: len(r.text) for r in out.collect()} == {i: n - gone for i, (n, gone, *_) in enumerate(brute([r[1] for r in rows], 100)) if n > gone}
    with pytest.raises(ValueError):
        sd.mark_repeats(docs)


def test_spans_are_united_without_a_loop_over_them():
    r = random.Random(4)
    lists = [[{"start": r.randint(0, 900), "windows": r.randint(1, 60)} for _ in range(r.choice([0, 1, 2, 5, 30]))] for _ in range(300)]
    want = []
    for parts in lists:
        spans = []
        for s, e in sorted((p["start"], p["start"] + p["windows"] - 1 + 64) for p in parts):
            if spans and s <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], e)
            else:
                spans.append({"start": s, "end": e})
        want.append(spans)
    arrow = pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32())])))
    assert sd._united(arrow, 64).to_pylist() == want
    assert sd._united(arrow.slice(7, 90), 64).to_pylist() == want[7:97]
    assert sd._united(arrow.slice(0, 0), 64).to_pylist() == []
