"""Corpus preparation in five stages, each of which calls one operator and lets its decisions take effect.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet and read again. All but the last return
the columns of `documents`. What the stage before has left in the driver is
removed first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerglass.llm import decontaminate, langid, mixing, ngram_join, suffix_dedup
from ledgerglass.llm.common import tidy, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no language that is likely."""
    tidy(spark)
    return langid.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    tidy(spark)
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 240 bytes that occur elsewhere go from the texts; what is nothing then is dropped.

    Passages of over 50 words have to go, and 99 of 100 strings of 51 words have 248 bytes or more.
    """
    tidy(spark)
    return suffix_dedup.remove_repeats(docs, suffix_dedup.PASSAGE)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    tidy(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; `mix_copy` numbers its copies."""
    tidy(spark)
    return mixing.emit(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
]

#: Near copies found by chance paths and a fitted language model have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
