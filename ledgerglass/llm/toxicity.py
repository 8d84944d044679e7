"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning.

Features are words and the 5-byte grams inside them, hashed to `BUCKETS`. Their
document frequencies are counted over all texts and over all confirmed toxic
ones, copies of one text among the latter counting once; those much more frequent in the latter become the model's inputs. The
classifier is linear in the unit vector of the inputs present in a text, fitted
with numpy on bounded samples by the non-negative risk estimator

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

where R_p and R_u are logistic risks over confirmed and unlabelled rows. The
prior is the share of toxic rows among the labelled ones that may be learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .bytescan import LOWER, WORD, SpanHash, U, blocks
from .common import join_by_size, small_batches, written
from .sampling import bounded, remainder

BITS = 20
BUCKETS = 1 << BITS
GRAM = 5
#: Confirmed texts that must share a bucket for it to become an input.
LEAST = 4


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every word and every gram inside a word, with repeats, ordered by text within words and within grams."""
    low = LOWER[data]
    ok = WORD[data] & ~((data >= 48) & (data <= 57))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], ok))
    now = np.concatenate((ok, [False]))
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    h = SpanHash(low)
    words = h(starts, ends)
    length = ends - starts
    long = length > GRAM
    many = np.where(long, length - GRAM + 1, 0)
    first = np.repeat(starts, many)
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    grams = h.grams(GRAM)[at] if len(at) else words[:0]
    position = np.concatenate((starts, at))
    bucket = (np.concatenate((words, grams ^ U(0xABCDEF))) >> U(64 - BITS)).astype(np.int64)
    return np.searchsorted(offsets, position, side="right") - 1, bucket


def _presence(column, chosen: np.ndarray | None = None):
    """(text, bucket) pairs without repeats for the texts of an Arrow column, block by block; only `chosen` buckets (a mask) if given."""
    for first, data, offsets in blocks(column):
        text, bucket = _features(data, offsets)
        if chosen is not None:
            keep = chosen[bucket]
            text, bucket = text[keep], bucket[keep]
        pair = np.unique((text << BITS) | bucket)
        yield first, len(offsets) - 1, pair >> BITS, pair & (BUCKETS - 1)


def representatives(texts: DataFrame) -> DataFrame:
    """doc_id of one text of each class of the n-gram join: copies would pass for evidence many times over. Texts without words have no inputs."""
    return ngram_join.join(texts).where("set_key is not null").select(F.col("class_id").alias("doc_id")).distinct()


def document_frequencies(texts: DataFrame, least: int, among: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """How many texts have each bucket (0 for those with fewer than `least`), only buckets `among` (a mask) if given; and how many texts there are."""
    shared = None if among is None else texts.sparkSession.sparkContext.broadcast(among)

    def count(batches):
        df = np.zeros(BUCKETS, dtype=np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for *_, bucket in _presence(batch.column("text"), None if shared is None else shared.value):
                df += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, total = np.zeros(BUCKETS), 0
    # at most one row for each bucket
    for r in counted.where((F.col("n") >= least) | (F.col("bucket") < 0)).collect():
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    return df, total


@dataclass
class Model:
    index: np.ndarray  # bucket -> input, or -1
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for first, n, text, bucket in _presence(column, self.index >= 0):
            total = np.bincount(text, weights=self.weights[self.index[bucket]], minlength=n)
            count = np.bincount(text, minlength=n)
            out[first : first + n] += total / np.sqrt(np.maximum(count, 1))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def choose(df, pos, n, p, inputs: int, ratio: float = 3.0) -> np.ndarray:
    """Buckets that confirmed texts have `ratio` times as often as all texts, and surely so; the surest first."""
    if not p or not n:
        return np.empty(0, np.int64)
    expected = p * np.maximum(df, 1) / n
    sure = (pos - expected) / np.sqrt(expected + 1)
    good = np.flatnonzero((pos >= LEAST) & (pos >= ratio * expected) & (sure > 5))
    return good[np.argsort(-sure[good], kind="stable")][:inputs]


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, l2: float = 1e-5, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; when the unlabelled part falls below zero, its gradient is turned round."""
    w = np.zeros(xp.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    grow = lambda x, g: np.append(g @ x, g.sum()) / max(1, len(g))
    for k in range(1, steps + 1):
        p, u = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        positive = prior * grow(xp, sigmoid(p) - 1)
        negative = grow(xu, sigmoid(u)) - prior * grow(xp, sigmoid(p))
        risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        g = positive + negative if risk >= 0 else -gamma * negative
        g[:-1] += l2 * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 8000, inputs: int = 1024) -> Model:
    """Learn from labels of rows whose id's remainder by 4 is not 2; the samples are bounded by the parameters.

    Without a confirmed example, every text gets the score of the prior, which is then 0.
    """
    small_batches(docs.sparkSession)
    may = labels.where((remainder("doc_id", 4) != 2) & F.col("toxic").isNotNull())
    seen, toxic = may.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    empty = Model(np.full(BUCKETS, -1, np.int32), np.zeros(1), -30.0)
    if not toxic:
        return empty
    prior = min(max(toxic / seen, 1e-4), 0.9)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = written(may.where("toxic = 1").select("doc_id").distinct(), "toxic")
    confirmed = written(representatives(join_by_size(texts, ids, "doc_id", "left_semi", 16 * toxic)), "confirmed")
    pos, p = document_frequencies(join_by_size(texts, confirmed, "doc_id", "left_semi", 16 * toxic), LEAST)
    df, n = document_frequencies(texts, 1, pos > 0)
    chosen = choose(df, pos, n, p, inputs)
    if not len(chosen):
        return empty
    index = np.full(BUCKETS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    ids = bounded(confirmed.select("doc_id"), "doc_id", positives).withColumn("part", F.lit(1))
    ids = ids.union(bounded(docs.select("doc_id").where("doc_id is not null"), "doc_id", unlabelled, "unlabelled").distinct().withColumn("part", F.lit(0)))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def featurise(batches):
        for batch in batches:
            inputs_of = [[] for _ in range(batch.num_rows)]
            for first, _, text, bucket in _presence(batch.column("text"), shared.value >= 0):
                for t, i in zip(text, shared.value[bucket], strict=True):
                    inputs_of[first + t].append(int(i))
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(inputs_of, pa.list_(pa.int32()))], names=["part", "found"])

    sample = texts.join(F.broadcast(ids), "doc_id").mapInArrow(featurise, "part int, found array<int>")
    # at most positives + unlabelled rows of at most `inputs` numbers
    sample = sorted((r.part, r.found) for r in sample.collect())

    def matrix(found):
        x = np.zeros((len(found), len(chosen)), dtype=np.float32)
        for k, f in enumerate(found):
            x[k, f] = 1 / np.sqrt(max(1, len(f)))
        return x

    xp, xu = (matrix([f for part, f in sample if part == k]) for k in (1, 0))
    if not len(xp) or not len(xu):
        return empty
    w, b = fit_nnpu(xp, xu, prior)
    return Model(index, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; a null or empty text has no inputs and gets the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
