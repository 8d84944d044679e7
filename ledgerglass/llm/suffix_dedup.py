"""Long repeated strings, found with a logarithmic family of sampled suffix arrays.

A batch of texts becomes one array of sampled suffixes. The sampling is by
content: in every window of `length` bytes the smallest hash of 32 bytes is the
anchor, so two equal windows have the same anchor at the same place. All
consecutive windows with one anchor form a *run*, kept as one entry:

* `rk`      fingerprint of the anchor's suffix, cut to half a window,
* `lk`      the same for the bytes before the anchor (a suffix of the reversed text),
* `k1`      fingerprint of all bytes of the run and of the anchor's place in it,
* `place`   where the run lies: first window, anchor and number of windows, in one long.

The array of a new batch holds its distinct runs in the order of their half
windows' fingerprints. It is merge-scanned (a sort-merge join) against each level
of the family: entries equal in `k1` are runs that repeat as a whole; entries that
share only half a window may share some windows. Levels of equal size are merged
before the next batch comes, so that after n batches there are at most
log2(n) + 1. Arrays are ordered by fingerprint, not by letter: matches shorter
than half a window never count, so the order within them is not needed. Levels
live in a folder, and `extend_index` adds a batch to what an earlier call left there.

Runs that share half a window are compared in ever smaller ranges of windows
(16, 1): a range whose bytes recur repeats, one whose windows' common bytes
recur is split, any other is dropped. All of it is Spark aggregates and joins on
fixed-width keys with partial results, and no text is shuffled unless the join of spans with texts has to.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import SpanHash, U, blocks, mix, signed, window_min
from .common import children, delete, discard, fresh_path, join_by_size, semi_join, small_batches, written

GRAM = 32
#: Bytes of a repeated passage of over 50 words: 99 % of the 51-word strings of the tables' four languages have at least 248.
PASSAGE = 240
#: Windows in a range, from one comparison to the next.
WIDTHS = (16, 1)
_ANCHOR_BITS = 28
_BITS = 10
_SECOND = 0x9FB21C651E98DF25


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows in a block: text index, place, k1, lk, rk and whether the last two hold."""
    n = len(data) - length + 1
    has = offsets[1:] - offsets[:-1] >= length
    if not has.any():
        return None
    h = SpanHash(data)
    grams = h.grams(GRAM)
    low = window_min((grams >> U(_ANCHOR_BITS) << U(_ANCHOR_BITS)) | np.arange(len(grams), dtype=U), length - GRAM + 1)
    anchor = (low & U((1 << _ANCHOR_BITS) - 1)).astype(np.int64)
    begin, end = offsets[:-1][has], offsets[1:][has] - length + 1
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    inside = np.cumsum(step[:n]) > 0
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = anchor[1:] != anchor[:-1]
    new[begin] = True
    new[end[end < n]] = True
    first = np.flatnonzero(new[:n] & inside)
    last = np.flatnonzero(new[1:] & inside)
    p = anchor[first]
    a_high = p - first  # the first window starts furthest before the anchor
    a_low = p - last
    k1 = mix(h(first, last + length) ^ mix(a_high.astype(U)))
    half = (length - GRAM) // 2
    left, right = a_high >= half, a_low < half
    lk = np.zeros(len(p), dtype=U)
    rk = np.zeros(len(p), dtype=U)
    lk[left] = h((p - half)[left], (p + GRAM)[left]) ^ U(1)
    rk[right] = h(p[right], (p + length - half + 1)[right])
    text = np.searchsorted(offsets, first, side="right") - 1
    place = ((first - offsets[text]) << (2 * _BITS)) | (a_high << _BITS) | (last - first + 1)
    return text, place, k1, lk, rk, left, right


def suffix_runs(texts: DataFrame, length: int) -> DataFrame:
    """texts (t1, t2, text) -> one entry per run of windows: t1, t2, place, k1, lk, rk."""

    def scan(batches):
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
            for at, data, offsets in blocks(batch.column("text")):
                found = _runs(data, offsets, length)
                if found is None:
                    continue
                text, place, k1, lk, rk, left, right = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t1[at + text]), pa.array(t2[at + text]), pa.array(place), pa.array(signed(k1)), pa.array(signed(lk), mask=~left), pa.array(signed(rk), mask=~right)],
                    names=["t1", "t2", "place", "k1", "lk", "rk"],
                )

    return texts.mapInArrow(scan, "t1 long, t2 long, place long, k1 long, lk long, rk long")


class SuffixIndex:
    """The family of sampled suffix arrays, in a folder that outlives the call.

    An array holds the distinct runs of its batches, a row for each half window
    (`left`, `key`), in the order of `key` and `k1`, with the number of occurrences
    (`times`) and the place of one of them. `state-*` tables name the levels; the
    newest complete one counts, so that a call that broke off leaves the index as
    it was. Merged levels stay until `drop` so that readers of an older state go on.
    """

    KEY = ["left", "key"]
    RUN = ["left", "key", "k1"]
    PLACE = ["t1", "t2", "place", "has_left"]

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = (folder or fresh_path(spark, "suffix-index")).rstrip("/")
        states = [x for x in children(spark, self.folder) if x.startswith("state-")]
        self.version = int(states[-1].removeprefix("state-")) if states else 0
        self.levels: list[tuple[int, str]] = []
        if states:
            # one row for each level, of which there are about as many as the logarithm of the batches
            self.levels = [(r.size, r.name) for r in spark.read.parquet(f"{self.folder}/{states[-1]}").orderBy("position").collect()]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _store(self, runs: DataFrame) -> str:
        name = f"array-{uuid.uuid4().hex}"
        runs.sortWithinPartitions("key", "k1").write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def _remember(self) -> None:
        self.version += 1
        rows = [F.struct(F.lit(i).alias("position"), F.lit(size).cast("long").alias("size"), F.lit(name).alias("name")) for i, (size, name) in enumerate(self.levels)]
        self.spark.range(1, numPartitions=1).select(F.inline(F.array(*rows))).write.parquet(f"{self.folder}/state-{self.version:09d}")

    def _merge_equal(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, x), (_, y) = self.levels.pop(), self.levels.pop()
            both = self._read(x).union(self._read(y))
            self.levels.append((2 * size, self._store(both.groupBy(*self.RUN).agg(F.sum("times").alias("times"), *(F.first(c).alias(c) for c in self.PLACE)))))

    def add(self, halves: DataFrame) -> DataFrame:
        """Make the array of a new batch (`half_windows` of its runs), merge-scan it against each level, and keep it as a level.

        Returns t1, t2, place, left, again, close: `again` says that a run repeats as a
        whole (once per occurrence), `close` that it is to be compared window by window
        on this side of its anchor (for one occurrence of equal runs). Runs of older
        batches appear where the new batch brings their first repetition or a new neighbour.
        Levels are only read where a half window of the new batch occurs.
        """
        self._merge_equal()
        # equal runs are counted before they are dealt, so that a run of any frequency is one row per task
        fresh = halves.groupBy(*self.RUN).agg(F.count(F.lit(1)).alias("times"), *(F.first(c).alias(c) for c in self.PLACE))
        name = self._store(fresh)
        fresh = self._read(name)
        columns = [*self.RUN, "times", *self.PLACE]
        runs, old, again_old = fresh.select(*columns), None, None
        if self.levels:
            keys = fresh.select(*self.KEY).hint("merge")
            for _, level in self.levels:
                met = self._read(level).select(*columns).join(keys, self.KEY, "left_semi")
                old = met if old is None else old.union(met)
            old = written(old, "met")
        known = runs if old is None else runs.union(old)
        shared = known.groupBy(*self.KEY).agg((F.min("k1") != F.max("k1")).alias("differ")).where("differ")
        close = semi_join(known, shared, self.KEY, SMALL_KEYS)
        # a run with both half windows is said once
        once = F.col("left") | ~F.col("has_left")
        repeated = fresh.where("times > 1").where(once).select(*self.RUN)
        again_old = None
        if old is not None:
            close = close.dropDuplicates(self.RUN)
            same = written(old.where(once).join(fresh.where(once).select(*self.RUN).hint("merge"), self.RUN, "left_semi"), "same")
            repeated = repeated.union(same.select(*self.RUN)).distinct()
            again_old = same.where("times = 1")
        again = _occurrences(halves.where(once), repeated, self.RUN)
        if again_old is not None:
            again = again.select(*self.PLACE, "left").union(again_old.select(*self.PLACE, "left"))
        again = again.select("t1", "t2", "place", "left", F.lit(True).alias("again"), F.lit(False).alias("close"))
        out = written(again.union(close.select("t1", "t2", "place", "left", F.lit(False).alias("again"), F.lit(True).alias("close"))), "scan")
        if old is not None:
            discard(old, same)
        self.levels.append((1, name))
        self._remember()
        return out

    def drop(self) -> None:
        """Remove the folder."""
        delete(self.spark, self.folder)


#: Keys of the arrays go by broadcast up to this size only: the many rows on the other side are narrow, so a shuffle of them costs little, and the same at every size.
SMALL_KEYS = 1 << 18

def _occurrences(halves: DataFrame, repeated: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `halves` whose run is in `repeated`; a run of any frequency is a key that Spark may split, as no side is aggregated between its shuffle and the join."""
    return semi_join(halves, written(repeated.select(*on), "repeated"), on, SMALL_KEYS)


def half_windows(entries: DataFrame) -> DataFrame:
    """A row for each half window that an entry has."""
    half = F.explode(F.array(F.struct(F.col("lk").alias("key"), F.lit(True).alias("left")), F.struct(F.col("rk").alias("key"), F.lit(False).alias("left"))))
    return entries.select("t1", "t2", "place", "k1", F.col("lk").isNotNull().alias("has_left"), half.alias("e")).select("t1", "t2", "place", "k1", "has_left", "e.*").where("key is not null")


def _ranges(texts: DataFrame, length: int, width: int) -> DataFrame:
    """texts (t1, t2, text, todo of anchor, lo, hi) -> t1, t2, anchor, lo, hi, c, f of the ranges of `width` windows in each.

    A window is given by how far before the anchor it starts. `c` stands for the
    bytes common to all windows of the range, `f` for all its bytes, null where
    the text has only some of its windows.
    """
    most = length - GRAM

    def scan(batches):
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
            todo = batch.column("todo")
            flat = todo.flatten()
            anchor, lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in todo])))
            for at, data, offsets in blocks(batch.column("text")):
                part = slice(ends[at], ends[at + len(offsets) - 1])
                p, low, high = anchor[part], lo[part], hi[part]
                if not len(p):
                    continue
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(ends[at : at + len(offsets)]))
                j0, j1 = low // width, high // width
                many = j1 - j0 + 1
                row = np.repeat(np.arange(len(p)), many)
                j = j0[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                p, owner = p[row] + offsets[owner[row]], owner[row]
                first, last = j * width, np.minimum(j * width + width - 1, most)
                low, high = np.maximum(low[row], first), np.minimum(high[row], last)
                c = mix(SpanHash(data)(p - first, p - last + length) ^ mix(j.astype(U)))
                f = SpanHash(data, _SECOND)(p - high, p - low + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t1[at + owner]), pa.array(t2[at + owner]), *(pa.array(x.astype(np.int32)) for x in (p - offsets[owner], low, high)), pa.array(signed(c)), pa.array(signed(f), mask=(low != first) | (high != last))],
                    names=["t1", "t2", "anchor", "lo", "hi", "c", "f"],
                )

    return texts.mapInArrow(scan, "t1 long, t2 long, anchor int, lo int, hi int, c long, f long")


def _compare(texts: DataFrame, close: DataFrame, length: int) -> list[DataFrame]:
    """close (t1, t2, anchor, lo, hi), no two runs equal -> tables (t1, t2, start, windows) of windows that recur."""
    out = []
    columns = ["t1", "t2", "anchor", "lo", "hi"]
    used: list[DataFrame] = []
    for width in WIDTHS:
        todo = written(close.groupBy("t1", "t2").agg(F.collect_set(F.struct("anchor", "lo", "hi")).alias("todo")), "todo")
        discard(*used)
        size = todo.agg(F.sum(64 + 16 * F.size("todo"))).first()[0]
        if not size:
            discard(todo)
            return out
        # equal texts bring equal rows; all but one are left out
        rows = written(_ranges(join_by_size(texts, todo, ["t1", "t2"], "inner", size), length, width).distinct(), "ranges")
        discard(todo)
        whole, partial = rows.where("f is not null"), rows.where("f is null")
        fulls = whole.groupBy("c", "f").agg(F.count(F.lit(1)).alias("times"), *(F.first(x).alias(x) for x in columns))
        fulls = written(fulls, "full-ranges")
        several = fulls.select("c").union(partial.select("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = _occurrences(whole, fulls.where("times > 1"), ["c", "f"])
        out.append(written(again.select("t1", "t2", (F.col("anchor") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + 1).alias("windows")), "windows"))
        close = semi_join(fulls.select("c", *columns).union(partial.select("c", *columns)), several, ["c"], SMALL_KEYS).select(*columns)
        used = [rows, fulls]
    discard(*used)
    return out


def text_key(text: str = "text"):
    """Two 64-bit hashes that stand for a text; equal texts have the same repeats."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("second"), t).alias("t2")


def _windows(docs: DataFrame, length: int, text: str) -> DataFrame:
    return docs.select(*text_key(text), F.col(text).alias("text")).where(F.octet_length("text") >= length)


def extend_index(index: SuffixIndex, docs: DataFrame, earlier: DataFrame | None, length: int = 400, text: str = "text") -> DataFrame:
    """Add `docs` to an index in its folder, and say what repeats because of them.

    Returns (t1, t2, spans), spans an array of (start, end) in bytes, of texts among
    `docs` and among `earlier`, the rows added before (None for none; only those
    that meet a new one are compared). The spans of all calls together cover what
    one call over all rows finds. An index is for one `length`.
    """
    texts = _windows(docs, length, text)
    halves = written(half_windows(suffix_runs(texts, length)), "halves")
    found = index.add(halves)
    discard(halves)
    known = texts if earlier is None else texts.union(_windows(earlier, length, text))
    return _spans(known, found, length)


def repeated_spans(docs: DataFrame, length: int = 400, batches: int = 2, text: str = "text") -> DataFrame:
    """(t1, t2, spans) of every text with repeats, spans an array of (start, end) in bytes, by an index of `batches` batches made for this call.

    Texts that come more than once are covered whole, and one row of each goes
    into the index, so that a group of copies costs as much as one text.
    """
    if not 2 * GRAM <= length < 1 << _BITS:
        raise ValueError(f"length must be from {2 * GRAM} to {(1 << _BITS) - 1} bytes")
    small_batches(docs.sparkSession)
    rows = _windows(docs, length, text)
    copies = rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("text")).alias("size")).where("n > 1")
    copies = written(copies, "copies")
    keys, size = copies.select("t1", "t2"), 48 * copies.count()
    one_each = written(join_by_size(rows, keys, ["t1", "t2"], "left_semi", size).groupBy("t1", "t2").agg(F.first("text").alias("text")), "one-each")
    texts = join_by_size(rows, keys, ["t1", "t2"], "left_anti", size).select("t1", "t2", "text").union(one_each)
    halves = written(half_windows(suffix_runs(texts, length)).withColumn("batch", F.pmod(F.col("t2"), F.lit(batches)).cast("int")), "halves")
    index = SuffixIndex(docs.sparkSession)
    found = None
    for b in range(batches):
        scan = index.add(halves.where(F.col("batch") == b).drop("batch"))
        found = scan if found is None else found.union(scan)
    index.drop()
    discard(halves)
    parts = join_by_size(_spans(texts, found, length), keys, ["t1", "t2"], "left_anti", size)
    whole = copies.select("t1", "t2", F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("end"))).alias("spans"))
    return parts.union(whole)


def _united(parts: pa.ListArray, length: int) -> pa.ListArray:
    """Lists of (start, windows) -> lists of (start, end) in order, those that overlap or touch made one."""
    flat = parts.flatten()
    start, windows = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    owner = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    end = start + windows - 1 + length
    # a text's spans lie before those of the next, with room between
    shift = owner * (int(end.max(initial=0)) + 2)
    order = np.argsort(start + shift, kind="stable")
    start, far = (start + shift)[order], np.maximum.accumulate((end + shift)[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > far[:-1]
    first = np.flatnonzero(new)
    shift = shift[order][first]
    sides = [pa.array((x - shift).astype(np.int32)) for x in (start[first], far[np.append(first[1:], len(start)) - 1] if len(first) else far)]
    ends = np.cumsum(np.bincount(owner[order][first], minlength=len(parts)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.StructArray.from_arrays(sides, names=["start", "end"]))


def _spans(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    start, before, count = F.shiftright("place", 2 * _BITS).cast("int"), F.shiftright("place", _BITS).bitwiseAND((1 << _BITS) - 1).cast("int"), F.col("place").bitwiseAND((1 << _BITS) - 1).cast("int")
    whole = found.where("again").select("t1", "t2", start.alias("start"), count.alias("windows"))
    half = (length - GRAM) // 2
    lo, hi = F.greatest(before - count + 1, F.when(F.col("left"), half).otherwise(0)), F.least(before, F.when(F.col("left"), length).otherwise(half - 1))
    close = found.where("close").select("t1", "t2", (start + before).alias("anchor"), lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    for part in _compare(texts, close, length):
        whole = whole.union(part)
    spans = whole.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "windows")).alias("parts"))

    def unite(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), _united(batch.column("parts"), length)], names=["t1", "t2", "spans"])

    return written(spans.mapInArrow(unite, "t1 long, t2 long, spans array<struct<start:int,end:int>>"), "spans")


def _bytes_of(spans: DataFrame) -> int:
    """Measured size of a table of spans."""
    return spans.agg(F.sum(48 + 16 * F.size("spans"))).first()[0] or 0


def _with_spans(docs: DataFrame, spans: DataFrame, text: str, name: str) -> DataFrame:
    """`docs` with the spans of its texts as column `name`, null where there are none."""
    k1, k2 = text_key(text)
    size = _bytes_of(spans)
    keyed = docs.select(F.struct("*").alias("row"), k1.alias("t1"), k2.alias("t2"))  # other columns may have any names
    return join_by_size(keyed, spans.select("t1", "t2", "spans"), ["t1", "t2"], "left", size).select("row.*", F.col("spans").alias(name))


def mark_repeats(docs: DataFrame, length: int = 400, batches: int = 2, text: str = "text", name: str = "repeat_spans") -> DataFrame:
    """`docs` with the column `name`: the byte ranges of its text that a string of `length` bytes found elsewhere covers.

    A null or short text has none; equal rows each count as an occurrence of
    their text, so a text of `length` bytes or more that comes twice is covered
    whole. Other columns, also such with names used inside, are kept as they are;
    a column called `name` would be hidden and is refused.
    """
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already; pass another name")
    return _with_spans(docs, repeated_spans(docs, length, batches, text), text, name)


def _kept(data: bytes, spans) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(data[at : s["start"]])
        at = s["end"]
    out.append(data[at:])
    return b"".join(out)


def digest(docs: DataFrame, length: int = 400, passage: int = PASSAGE, batches: int = 2) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and n_passage: the bytes covered by repeats of `passage` bytes.

    Repeats of `length` bytes can only lie where repeats of the shorter `passage`
    cover as much, so `length` is looked for among such texts alone, in one batch.
    """
    docs = docs.select("doc_id", "text")
    shorter = repeated_spans(docs, min(passage, length), batches)
    long_enough = shorter.where(F.exists("spans", lambda s: s["end"] - s["start"] >= length)).select("t1", "t2")
    keyed = docs.select("text", *text_key("text"))
    exact = shorter
    if length > passage and not long_enough.isEmpty():
        exact = repeated_spans(semi_join(keyed, long_enough, ["t1", "t2"]).select("text"), length, 1)
    elif length > passage:
        exact = shorter.limit(0)

    def run(it):
        for batch in it:
            sizes, gone, count, sha, passages = [], [], [], [], []
            for text, spans, short in zip(batch.column("text"), batch.column("exact").to_pylist(), batch.column("shorter").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                kept = _kept(raw, spans)
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept))
                count.append(len(spans or ()))
                sha.append(hashlib.sha256(kept).hexdigest())
                passages.append(sum(s["end"] - s["start"] for s in short or ()))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, gone, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(sha, pa.string()), pa.array(passages, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    marked = _with_spans(_with_spans(docs, exact, "text", "exact"), shorter, "text", "shorter")
    kind = dict(docs.dtypes)["doc_id"]
    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")


def remove_repeats(docs: DataFrame, length: int = 400, batches: int = 2) -> DataFrame:
    """`docs` with the repeated bytes cut from `text` (half characters at a cut go too) and `n_chars` counted anew.

    A document of which nothing is left is dropped; null and empty texts stay.
    """

    def cut(texts, spans):
        return [None if t is None else _kept(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]

    columns = docs.columns
    spans_of, gone_of = (next(f"{x}{i or ''}" for i in range(len(columns) + 1) if f"{x}{i or ''}" not in columns) for x in ("repeat_spans", "__cut"))
    schema = T.StructType([*docs.schema.fields, T.StructField(gone_of, T.BooleanType())])

    def run(it):
        for batch in it:
            table = pa.Table.from_batches([batch])
            texts, spans = table["text"].to_pylist(), table[spans_of].to_pylist()
            new = cut(texts, spans)
            gone = pa.array([bool(s) and not t for t, s in zip(new, spans, strict=True)])
            table = table.set_column(table.column_names.index("text"), "text", pa.array(new, table.schema.field("text").type))
            table = table.drop_columns([spans_of]).append_column(gone_of, gone)
            yield from table.to_batches()

    out = mark_repeats(docs, length, batches, name=spans_of).mapInArrow(run, schema).where(~F.col(gone_of)).drop(gone_of)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*columns)
