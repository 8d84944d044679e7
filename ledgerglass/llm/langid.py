"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts become lower-case letters with single spaces between words; grams of one
to three characters are hashed to `BUCKETS`. Document frequencies come from all
rows that may be learnt from. The weights are fitted by follow-the-regularised-
leader with L1 and L2 penalties on at most `per_lang` rows of each language,
and a temperature fitted on a fifth of them, held back, calibrates the scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .sampling import bounded, remainder

BUCKETS = 1 << 15
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters, with one space before, between and after words; empty without a letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = cp < 1 << 16
    is_letter = _letters()[np.where(low, cp, 0)] & low
    if not low.all():
        far = np.flatnonzero(~low)
        is_letter[far] = [chr(c).isalpha() for c in cp[far]]
    if not is_letter.any():
        return cp[:0]
    c = np.empty(len(cp) + 2, dtype=np.uint32)
    c[0] = c[-1] = 32
    c[1:-1] = np.where(is_letter, cp, 32)
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the grams of a text."""
    c = letters(text)
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
        all_of = np.concatenate((one, two, three))
        all_of ^= all_of >> np.uint32(15)
        all_of *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(all_of >> np.uint32(32 - 15), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # one row per bucket, the last for the bias
    temperature: float

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return vector(found, counts, self.idf) @ self.weights[found] + self.weights[-1]


def vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length, with logarithmic counts."""
    x = (1 + np.log(counts)) * idf[found]
    return x / (np.sqrt(x @ x) or 1.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(xs, ys, classes: int, alpha=0.5, beta=1.0, l1=0.002, l2=0.002, epochs=3) -> np.ndarray:
    """xs: (buckets, values) pairs; per-coordinate FTRL-proximal with elastic net; the bias is not penalised."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))
    penal = np.full((BUCKETS + 1, 1), l1)
    penal[-1] = 0

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * penal[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= penal[i], 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(xs)):
            i, v = xs[k]
            i, v = np.append(i, BUCKETS), np.append(v, 1.0)
            w = weights(i)
            g = _softmax(v @ w)
            g[ys[k]] -= 1
            g = v[:, None] * g
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(BUCKETS + 1))


def fit_temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""

    def loss(t):
        x = logits / math.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(ys)), ys]))

    a, b, r = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train(docs: DataFrame, per_lang: int = 1200) -> Model | None:
    """Learn from rows with a language whose id's remainder by 4 is not 2; None if there is no such row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))

    def frequencies(batches):
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df[grams(text)[0]] += 1
                n += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS)
    total = 0
    for r in counted:
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())

    def featurise(batches):
        for batch in batches:
            pairs = [grams(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("lang"), *(pa.array([p[k].astype(np.int32).tobytes() for p in pairs], pa.binary()) for k in (0, 1))],
                names=["id", "lang", "found", "counts"],
            )

    sample = None
    ids = rows.select("doc_id", "lang")
    for lang in langs:
        part = bounded(ids.where(F.col("lang") == lang), "doc_id", per_lang).select("doc_id").distinct()
        sample = part if sample is None else sample.union(part)
    chosen = rows.join(F.broadcast(sample), "doc_id", "left_semi").mapInArrow(featurise, "id string, lang string, found binary, counts binary")
    # a sample of at most per_lang rows for each language
    chosen = sorted(((r.id, r.lang, np.frombuffer(r.found, np.int32), np.frombuffer(r.counts, np.int32)) for r in chosen.collect()), key=lambda r: (r[0], r[1], len(r[2])))
    xs = [(f, vector(f, c, idf)) for _, _, f, c in chosen]
    ys = np.array([langs.index(lang) for _, lang, _, _ in chosen])
    back = np.arange(len(xs)) % 5 == 4
    weights = fit_ftrl([x for x, b in zip(xs, back, strict=True) if not b], ys[~back], len(langs))
    model = Model(langs, idf, weights, 1.0)
    if back.any():
        logits = np.array([v @ weights[f] + weights[-1] for (f, v), b in zip(xs, back, strict=True) if b])
        model.temperature = fit_temperature(logits, ys[back])
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """`docs` (only the columns `keep`, if given) with lang_pred and score.

    A null text, a text without a letter and every text when nothing could be
    learnt is `und` with score 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep]

    def scan(batches):
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("__text").to_pylist():
                found, counts = grams(text) if text and m else ((), ())
                if not len(found):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                p = _softmax(m.logits(found, counts) / m.temperature)
                best = int(p.argmax())
                langs.append(m.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(scan, schema)


def digest(docs: DataFrame, per_lang: int = 1200) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; a null id counts as not held out and is not learnt from."""
    rows = predict(docs, train(docs, per_lang), ["doc_id"])
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35, per_lang: int = 1200) -> DataFrame:
    """`docs` without those that have no language or one with a score below `least`."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    out = predict(rows, train(docs, per_lang), ["__row"])
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("__row.*")
