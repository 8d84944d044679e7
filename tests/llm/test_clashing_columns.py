"""Every operator of the pipeline on tables whose other columns have the names that are used inside, and on odd tables."""

import corpus_pipeline
import pytest

from ledgerglass.llm import decontaminate, mixing, ngram_join, suffix_dedup

NAMES = ["__id", "__k1", "__t1", "__source", "__rate", "__row", "row", "id", "words", "t1", "t2", "u", "of", "rate", "copies", "spans", "repeat_spans", "__cut", "some_id", "node", "mix_copy", "class_id", "n_links", "set_key", "size", "target"]
TEXT = "one two three four five six seven eight nine ten eleven twelve " * 12


def table(spark, rows):
    wide = [(*r, *(f"{n}-{r[0]}" for n in NAMES)) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))


def rows():
    return [(1, TEXT, "en", "s", len(TEXT)), (2, TEXT, "en", "s", len(TEXT)), (3, "a short one of its own", "en", "t", 22), (3, "a short one of its own", "en", "t", 22), (4, None, None, None, None), (5, "", "en", None, 0), (6, "known words of the item that come in a row here today " * 3, "en", "t", 100)]


def extra(df):
    return all(r[n] == f"{n}-{r['doc_id']}" for r in df.collect() for n in NAMES)


def test_other_columns_are_kept(spark):
    docs = table(spark, rows())
    items = spark.createDataFrame([(1, "known words of the item that come in a row here today", "x")], "item_id long, text string, t1 string")
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns and extra(one) and sorted(r.doc_id for r in one.collect()) == [1, 3, 4, 5, 6]
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and extra(cut) and {1, 2}.isdisjoint(r.doc_id for r in cut.collect())
    marked = suffix_dedup.mark_repeats(docs, name="repeats")
    assert marked.columns == [*docs.columns, "repeats"] and extra(marked)
    clean = decontaminate.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and extra(clean) and 6 not in {r.doc_id for r in clean.collect()}
    mixed = mixing.emit(docs)
    assert mixed.columns == [*docs.columns, "mix_copy1"] and extra(mixed) and {r.mix_copy1 for r in mixed.collect()} <= {1, 2}
    for digest in (ngram_join.digest, suffix_dedup.digest, mixing.digest):
        assert digest(docs).count() == 7
    assert decontaminate.digest(docs, items).count() == 7


@pytest.mark.parametrize("kind", ["none", "nulls"])
def test_pipeline_on_odd_tables(spark, sf, kind):
    """Without rows, and with nothing but nulls: later stages get empty tables with the same columns."""
    docs = spark.createDataFrame([(None, None, None, None, None)] * (3 if kind == "nulls" else 0), "doc_id long, text string, lang string, source string, n_chars long")
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs.union(some), sf) if docs.columns == some.columns else docs
    assert docs.count() == 0 and docs.columns[-1] == "mix_copy"
