"""Differences of rule texts by sentence."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE_END = r"(?<=[。；：！？])|\n+"

_HUNK = T.StructType([T.StructField("op", T.StringType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("removed", "added", "ctx_before", "ctx_after"))])
DIFF = T.StructType([T.StructField("hunks", T.ArrayType(_HUNK)), *(T.StructField(n, T.IntegerType()) for n in ("sent_added", "sent_removed", "sent_equal")), T.StructField("change_ratio", T.DoubleType())])


def sentences(text: Column, end: str = SENTENCE_END) -> Column:
    """Trimmed sentences that are not blank."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), end), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def _split(text: str | None) -> list[str]:
    return [s for s in (p.strip() for p in re.split(SENTENCE_END, text or "")) if s]


def compare(old: str | None, new: str | None) -> dict:
    """Hunks with one sentence of context, counts, and changed sentences over twice the longer side."""
    before, after = _split(old), _split(new)
    steps = difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes()
    changed = [s for s in steps if s[0] != "equal"]
    gone, come = sum(s[2] - s[1] for s in changed), sum(s[4] - s[3] for s in changed)
    return {
        "hunks": [{"op": op, "removed": before[i:j], "added": after[k:m], "ctx_before": before[:i][-1:], "ctx_after": before[j:][:1]} for op, i, j, k, m in changed],
        "sent_added": come,
        "sent_removed": gone,
        "sent_equal": len(before) - gone,
        "change_ratio": round((gone + come) / max(2 * len(before), 2 * len(after), 2), 4),
    }


@F.pandas_udf(DIFF)
def sentence_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(o, n) for o, n in zip(old, new, strict=True)], columns=DIFF.names)


def changelog(events: DataFrame, texts_old: DataFrame, texts_new: DataFrame, month: str, many_new: int = 50) -> tuple[DataFrame, DataFrame]:
    """Changes (revised and silent edits) with their differences, and one row that sums the month up."""
    changed = events.where(F.col("kind").isin("revised", "silent_edit"))
    rows = changed.join(texts_old.select("code", F.col("text").alias("old_text")), "code", "left").join(texts_new.select("code", F.col("text").alias("new_text")), "code", "left")
    rows = rows.withColumn("diff", sentence_diff("old_text", "new_text")).select("code", "kind", "effective", "diff.*", F.concat(F.lit(f"{month}/"), F.translate(F.regexp_replace("code", r"\.+$", ""), ".", "-"), F.lit(".json")).alias("diff_file"))
    new = F.array_sort(F.collect_list(F.when(F.col("kind") == "new", F.col("code"))))
    total = events.agg(
        F.lit(month).alias("month"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{n}") for k, n in (("revised", "revised"), ("silent_edit", "silent_edit"), ("new", "new"), ("fetch_stale", "stale"))),
        F.when(F.count_if(F.col("kind") == "new") < many_new, new).otherwise(F.array().cast("array<string>")).alias("new_sections"),
    )
    return rows, total
