"""Benchmark decontamination by winnowing.

A window is `window` consecutive words; an item with fewer words (but not none)
is one window of its own length. In a window of t words the smallest hash of
the k = (t + 1) // 2-word grams is its fingerprint, so equal windows have equal
fingerprints: every shared span of `window` words is found, none is missed.
Training windows whose fingerprint no item has are dropped where they are made;
the others are joined with the items' windows on fingerprint and the 128-bit
hash of all t words, which extends the hit from the gram to the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import U, blocks, mix, row_grams, signed, window_min, words
from .common import BROADCAST_BYTES, join_by_size, small_batches, written
from .suffix_dedup import text_key

_SIEVE = 1 << 22
_HIT = pa.list_(pa.struct([("t", pa.int32()), ("fp", pa.int64()), ("start", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())]))
_HIT_TYPE = T.StructType([T.StructField("t", T.IntegerType()), *(T.StructField(n, T.IntegerType() if n == "start" else T.LongType()) for n in ("fp", "start", "w1", "w2"))])


def _window_rows(h: np.ndarray, at: np.ndarray, t: int):
    """First word and fingerprint of every window of t words; `h` word hashes, `at` where each text's words begin."""
    k = (t + 1) // 2
    low = window_min(row_grams(h, k), t - k + 1)
    if not len(low):
        return np.empty(0, np.int64), low
    room = np.repeat(at[1:], np.diff(at))[: len(low)]
    s = np.flatnonzero(np.arange(t, len(low) + t) <= room)
    return s, low[s]


def _window_hash(h: np.ndarray, s: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(len(s), U), np.zeros(len(s), U)
    with np.errstate(over="ignore"):
        for i in range(t):
            x = h[s + i]
            a = a * U(0x9E3779B97F4A7C15) + x
            b = b * U(0xC2B2AE3D27D4EB4F) + mix(x ^ U(0x51ED270B))
        return mix(a), mix(b)


def item_windows(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, t, fp, w1, w2 of every window of every item; items without words have none."""

    def scan(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch.column("text")):
                _, _, h, at = words(data, offsets)
                n = np.diff(at)
                for t in np.unique(np.minimum(n[n > 0], window)):
                    t = int(t)
                    s, fp = _window_rows(h, at, t)
                    d = np.searchsorted(at, s, side="right") - 1
                    own = (n[d] == t) | (t == window)
                    s, fp, d = s[own], fp[own], d[own]
                    w1, w2 = _window_hash(h, s, t)
                    ids = batch.column("item_id").take(pa.array(first + d))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(s), t, np.int32)), *(pa.array(signed(x)) for x in (fp, w1, w2))], names=["item_id", "t", "fp", "w1", "w2"])

    kind = dict(items.dtypes)[item_id]
    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(scan, f"item_id {kind}, t int, fp long, w1 long, w2 long")


def _document_hits(docs: DataFrame, lengths: list[int], known) -> DataFrame:
    """docs (t1, t2, text, ...) -> the other columns, n_words and the windows whose fingerprint is `known` (a broadcast array, or None: all)."""
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def scan(batches):
        if known is not None:
            fps = known.value
            sieve = np.zeros(_SIEVE, dtype=bool)
            sieve[(fps & U(_SIEVE - 1)).astype(np.int64)] = True
        for batch in batches:
            counts, hits = [], []
            for _, data, offsets in blocks(batch.column("text")):
                _, _, h, at = words(data, offsets)
                counts.append(np.diff(at))
                n, found = len(offsets) - 1, []
                for t in lengths:
                    s, fp = _window_rows(h, at, t)
                    if known is not None:
                        maybe = np.flatnonzero(sieve[(fp & U(_SIEVE - 1)).astype(np.int64)])
                        s, fp = s[maybe], fp[maybe]
                        i = np.minimum(np.searchsorted(fps, fp), len(fps) - 1)
                        s, fp = s[fps[i] == fp], fp[fps[i] == fp]
                    found.append((s, np.full(len(s), t, np.int32), fp, *_window_hash(h, s, t)))
                s, t, fp, w1, w2 = (np.concatenate(x) for x in zip(*found, strict=True))
                d = np.searchsorted(at, s, side="right") - 1
                order = np.argsort(d, kind="stable")
                values = pa.StructArray.from_arrays(
                    [pa.array(t[order]), pa.array(signed(fp[order])), pa.array((s - at[d])[order].astype(np.int32)), pa.array(signed(w1[order])), pa.array(signed(w2[order]))], fields=list(_HIT.value_type)
                )
                ends = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n)))).astype(np.int32)
                hits.append(pa.ListArray.from_arrays(pa.array(ends), values, type=_HIT))
            if counts:
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(np.concatenate(counts)), pa.concat_arrays(hits)], names=[*(f.name for f in keep), "n_words", "hits"])

    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_HIT_TYPE))])
    return docs.mapInArrow(scan, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, t1, t2 (the text's hashes), n_words, n_hit, spans (hit word ranges), items (ids, sorted as strings).

    Null and empty texts have no words and no hits; an item or document that
    comes twice counts as it is; null item ids are left out of `items`.
    """
    small_batches(docs.sparkSession)
    windows = item_windows(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), window)
    windows = windows.groupBy("t", "fp", "w1", "w2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    windows = written(windows, "item-windows")
    spark = docs.sparkSession
    size, fps = windows.agg(F.sum(40 + 16 * F.size("items")), F.count_distinct("fp")).first()
    lengths = sorted(r.t for r in windows.select("t").distinct().collect())  # at most `window` numbers
    known = None
    if 8 * fps <= BROADCAST_BYTES:  # else every window goes to the join
        known = spark.sparkContext.broadcast(np.sort(np.array([r.fp for r in windows.select("fp").distinct().collect()], dtype=np.int64).view(U)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text), F.col(text).alias("text"))
    if not lengths:
        lengths, known = [window], spark.sparkContext.broadcast(np.zeros(1, dtype=U))
    rows = written(_document_hits(rows, lengths, known), "hits")
    hits = rows.where(F.size("hits") > 0).select("t1", "t2", F.explode("hits").alias("h")).select("t1", "t2", "h.*").distinct()
    found = join_by_size(hits, windows, ["t", "fp", "w1", "w2"], "inner", size or 0)
    found = found.groupBy("t1", "t2").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("t")).alias("end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    step = "aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>), (a, s) -> CASE WHEN size(a) > 0 AND s.start <= element_at(a, -1).end THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))) ELSE concat(a, array(s)) END)"
    found = found.withColumn("spans", F.expr(step)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"))
    found = written(found, "found")
    size = found.agg(F.sum(64 + 8 * F.size("spans") + 16 * F.size("items"))).first()[0] or 0
    out = join_by_size(rows.drop("hits"), found, ["t1", "t2"], "left", size)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return out.select("doc_id", "t1", "t2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def digest(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    out = contamination(docs, items, window)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the rows in which a window of an item occurs; all else, null texts too, stays as it is."""
    bad = contamination(docs, items, window).where("n_hit > 0").select("t1", "t2").distinct()
    bad = written(bad, "contaminated")
    k1, k2 = text_key()
    keyed = docs.select(F.struct("*").alias("row"), k1.alias("t1"), k2.alias("t2"))  # other columns may have any names
    return join_by_size(keyed, bad, ["t1", "t2"], "left_anti", 24 * bad.count()).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS t, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
ts AS (SELECT DISTINCT t FROM iw),
dw AS (SELECT doc_id, t, s, array_to_string(list_slice(w, s, s + t - 1), ' ') AS x
       FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS s FROM d, ts WHERE len(w) >= t)),
hit AS (SELECT DISTINCT doc_id, s, t, x FROM dw WHERE (t, x) IN (SELECT t, x FROM iw)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + t)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit JOIN iw USING (t, x)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
