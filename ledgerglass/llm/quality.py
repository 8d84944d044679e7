"""Text quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words. Each passage is encoded from
measures of its characters, words and repeats; gated attention weighs the
passages, and the weighted mean is scored. Encoder, attention and score are
learnt together from labels of whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import SpanHash, U, blocks, mix
from .common import small_batches
from .mixing import _SPACE
from .sampling import bounded, remainder

PASSAGE = 64
_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!", "?", "#$%&*@^~", "|", "\n", "'\"()-", "+=<>/\\_[]{}`"]
_GROUP = np.full(256, len(_GROUPS), dtype=np.int64)
for _i, _g in enumerate(_GROUPS):
    _GROUP[[ord(c) for c in _g]] = _i
_GROUP[[9, 11, 12, 13, 32]] = -1
_LAGS = (1, 2, 3)
WIDTH = len(_GROUPS) + 1 + 2 + len(_LAGS) + 2


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage of a block, and where each text's passages begin; a text without words has one of zeros."""
    n = len(offsets) - 1
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid))
    now = np.concatenate((solid, [False]))
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    at = np.searchsorted(starts, offsets)
    count = np.diff(at)
    bags = np.maximum(1, -(-count // PASSAGE))
    begin = np.concatenate(([0], np.cumsum(bags)))
    out = np.zeros((begin[-1], WIDTH))
    if not len(starts):
        return out, begin
    owner = np.repeat(np.arange(n), count)
    within = np.arange(len(starts)) - at[owner]
    place = begin[owner] + within // PASSAGE
    words = np.maximum(1, np.bincount(place, minlength=begin[-1]))
    # bytes belong to the passage of the word before them, those before a text's first word to its first passage
    byte_place = np.repeat(np.concatenate(([0], place)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    byte_place = np.maximum(byte_place, np.repeat(begin[:-1], np.diff(offsets)))
    group = _GROUP[data]
    inside = group >= 0
    k = len(_GROUPS) + 1
    chars = np.bincount(byte_place[inside] * k + group[inside], minlength=begin[-1] * k).reshape(-1, k)
    total = np.maximum(1, chars.sum(axis=1))
    out[:, :k] = chars / total[:, None]
    out[:, k] = np.log1p(total / words)
    out[:, k + 1] = np.log1p(words)
    h = SpanHash(data)(starts, ends)
    column = k + 2
    for lag in _LAGS:
        same = np.zeros(len(h), dtype=bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])
        out[:, column] = np.bincount(place, weights=same, minlength=begin[-1]) / words
        column += 1
    # words and pairs of words that the text had before
    pair = h.copy()
    pair[1:] ^= mix(h[:-1])
    for x in (h, pair):
        key = mix(x + owner.astype(U) * U(0x9E3779B97F4A7C15))
        first = np.unique(key, return_index=True)[1]
        again = np.ones(len(key))
        again[first] = 0
        out[:, column] = np.bincount(place, weights=again, minlength=begin[-1]) / words
        column += 1
    out[begin[:-1][count == 0]] = 0
    return out, begin


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    shift: float = 0.0

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict:
        x = np.hstack(((x - self.mean) / self.scale, np.ones((len(x), 1))))
        h = np.tanh(x @ self.encode)
        t, s = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-h @ self.gate))
        e = (t * s) @ self.attend
        bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        a = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
        a /= np.add.reduceat(a, begin[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
        logit = z @ self.out[:-1] + self.out[-1]
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "logit": logit}

    def scores(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, begin)["logit"] + self.shift, -500, 500)))


def gradients(m: Model, f: dict, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss of the bags whose forward pass is `f`, by parameter."""
    dl = weight * (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
    g = {"out": np.append(dl @ f["z"], dl.sum())}
    dz = (dl[:, None] * m.out[:-1])[f["bag"]]
    da = (dz * f["h"]).sum(axis=1)
    mean = np.bincount(f["bag"], weights=f["a"] * da)
    de = f["a"] * (da - mean[f["bag"]])
    g["attend"] = de @ (f["t"] * f["s"])
    dts = de[:, None] * m.attend
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    g["tanh"], g["gate"] = f["h"].T @ dt, f["h"].T @ ds
    dh = f["a"][:, None] * dz + dt @ m.tanh.T + ds @ m.gate.T
    g["encode"] = f["x"].T @ (dh * (1 - f["h"] ** 2))
    return g


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, prior: float, hidden: int = 16, attention: int = 8, epochs: int = 60, batch: int = 128, rate: float = 0.01) -> Model:
    """Adam on the log loss with both classes weighed alike; `prior`, the share of label 1, then shifts the score."""
    r = np.random.default_rng(11)
    scale = x.std(axis=0)
    m = Model(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), r.normal(0, 0.3, (x.shape[1] + 1, hidden)), r.normal(0, 0.3, (hidden, attention)), r.normal(0, 0.3, (hidden, attention)), r.normal(0, 0.3, attention), r.normal(0, 0.3, hidden + 1))
    names = ["encode", "tanh", "gate", "attend", "out"]
    mom = {k: (np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))) for k in names}
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            f = m.forward(x[rows], np.concatenate(([0], np.cumsum(np.diff(begin)[docs]))))
            g = gradients(m, f, y[docs], weight[docs])
            step += 1
            for k in names:
                a, b = mom[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                getattr(m, k)[...] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.shift = float(np.log(prior / (1 - prior)))
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model | None:
    """Learn from labels of rows whose id's remainder by 3 is not 1, at most `per_class` rows of each label; None without both."""
    small_batches(docs.sparkSession)
    may = labels.where((remainder("doc_id", 3) != 1) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    counts = {r.label: r.n for r in may.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    ids = [bounded(may.where(F.col("label") == k), "doc_id", per_class) for k in (0, 1)]

    def featurise(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch.column("text")):
                x, begin = passages(data, offsets)
                n = len(offsets) - 1
                rows = pa.array([x[begin[i] : begin[i + 1]].astype(np.float32).tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, n), batch.column("label").slice(first, n), rows], names=["id", "label", "bag"])

    # the samples are bounded, and of a passage only its measures are fetched
    sample = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1]).distinct()), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "label", "text").mapInArrow(featurise, "id string, label int, bag binary")
    sample = sorted((r.id, r.label, bytes(r.bag)) for r in sample.collect())
    if len({label for _, label, _ in sample}) < 2:
        return None
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for *_, b in sample]
    begin = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    return fit(np.vstack(bags).astype(np.float64), begin, np.array([label for _, label, _ in sample]), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row; null and empty texts are one passage of zeros; without a model all get 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = [np.full(len(o) - 1, 0.5) if shared.value is None else shared.value.scores(*passages(d, o)) for _, d, o in blocks(batch.column("text"))]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
