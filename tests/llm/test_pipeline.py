"""The pipeline on the small tables, stage by stage against brute force."""

import re

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_mixing import targets
from test_ngram_join import brute as linked
from test_suffix_dedup import brute as repeats

from ledgerglass.llm import langid
from ledgerglass.llm.common import written


def rows_of(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        results.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    start = spark.read.parquet(f"{sf}/documents.parquet")
    identified, single, cut, clean, mixed = map(rows_of, results[:4] + [results[4].drop("mix_copy")])

    guesses = {r.doc_id: r for r in langid.predict(start, langid.train(start), ["doc_id"]).collect()}
    assert identified == [r for r in rows_of(start) if guesses[r[0]].lang_pred != "und" and guesses[r[0]].score >= 0.35]

    found = linked([r[1] for r in identified])
    assert single == [r for i, r in enumerate(identified) if found[i][0] == i]

    left = repeats([r[1] for r in single], 240)
    assert [r[0] for r in cut] == [r[0] for r, x in zip(single, left, strict=True) if not x[1] or x[1] < x[0]]
    assert all(len(r[1]) == r[4] for r in cut)
    size = {r[0]: x[0] - x[1] for r, x in zip(single, left, strict=True)}
    assert all(size[r[0]] - 8 <= len(r[1].encode()) <= size[r[0]] for r in cut)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = contaminated([(r[0], r[1]) for r in cut], items, 10)
    assert clean == [r for r in cut if not bad[r[0]][-1]]

    words = {}
    for r in clean:
        words[r[3]] = words.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    want = targets(words)
    copies = {}
    for r in mixed:
        copies[r[0]] = copies.get(r[0], 0) + 1
    for r in clean:
        rate = want[r[3]] / words[r[3]]
        assert int(rate) <= copies.get(r[0], 0) <= int(rate) + (rate % 1 > 0)
    assert set(mixed) <= set(clean)


def test_stages_tidy_the_driver_first(spark, sf, monkeypatch):
    import corpus_pipeline as cp

    calls = []
    monkeypatch.setattr(cp, "tidy", lambda _: calls.append("tidy"))
    for module, name in ((cp.langid, "keep_identified"), (cp.ngram_join, "keep_one"), (cp.suffix_dedup, "remove_repeats"), (cp.decontaminate, "remove_contaminated"), (cp.mixing, "emit")):
        monkeypatch.setattr(module, name, lambda *_: calls.append("work"))
    for _, stage in cp.STAGES:
        stage(spark, None, sf)
    assert calls == ["tidy", "work"] * len(cp.STAGES)
