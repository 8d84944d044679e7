"""Ranked lexical search over sharded postings with integer impacts.

The index is a table of shards of documents. A shard holds, in compressed sparse
rows, for each of its terms (64-bit hashes, ascending) the documents that hold it
and the integer impact of the term in each of them. An impact depends on the
term's frequency, the document's length and the corpus's two totals, so it is
computed once; a term's weight needs its document frequency and is applied when
terms are looked up.

A search takes queries in blocks of bounded size. For each block one pass over the
terms of all shards gives document frequencies, a second adds weight times
impact, term at a time, into a dense accumulator over a shard's documents. The
best k of a shard are selected exactly, ties included, tasks merge those of their
shards, and two windows merge the tasks'.

Two terms with the same hash would count as one; for 10^4 query terms against 10^9
different terms the chance of one such pair is below 10^-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bytescan import LOWER, WORD, blocks, signed, words
from .common import fresh_path, small_batches, written

#: Postings after which a shard is closed; about 1 MB of text, and 2 MB in the index.
SHARD_POSTINGS = 1 << 18
#: Shards that a task has in memory at once.
SHARDS_AT_ONCE = 16
#: Terms, and items, of a block of queries.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 5_000
#: Candidates that a task holds before it selects the best of each item.
HELD = 1 << 20

_SHARD = [T.StructField(n, T.BinaryType()) for n in ("terms", "starts", "docs", "impacts")]


@contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Arrow batches of at most `n` rows for what runs inside; the session's own setting holds again after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def corpus_totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for _, data, offsets in blocks(b.column(0)):
                solid = WORD[LOWER[data]]
                start = solid.copy()
                start[1:] &= ~solid[:-1]
                inner = offsets[offsets < len(data)]
                start[inner] = solid[inner]
                each = np.diff(np.concatenate(([0], np.cumsum(start)))[offsets])
                n, total = n + int((each > 0).sum()), total + int(each.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = docs.select(F.col(text).alias("text")).mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(row[0] or 0), int(row[1] or 0)


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Saturated term frequency in whole numbers, longer documents saturating later."""
    m = 50 + (50 * length * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, n_docs: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, term, tf of each different pair of a block, and each document's number of terms."""
    _, _, hashes, first = words(data, offsets)
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((hashes, doc))
    doc, term = doc[order], signed(hashes[order])
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc))), lengths


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The index of all rows of `docs`, written to `path` (else to the shared folder); its `corpus` is (documents, terms).

    Every row is a document of its own, whatever its id; null texts and those without a
    term are in no shard. A shard's documents lie in the order of their ids, null ids last.
    A very long text makes a shard larger, never shorter. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    n_docs, total = corpus_totals(docs, text)
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("n_docs", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), *_SHARD])

    def shard(ids: list[pa.Array], parts: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays(ids)
        by_id = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        doc, term, tf, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = place[doc]
        order = np.lexsort((doc, term))
        doc, term = doc[order], term[order]
        value = impact(tf[order], length[order], n_docs, total)
        new = np.ones(len(term), dtype=bool)
        new[1:] = term[1:] != term[:-1]
        starts = np.append(np.flatnonzero(new), len(term)).astype(np.int32)
        blobs = [term[starts[:-1]], starts, doc.astype(np.int32), value.astype(np.int32)]
        ordered = ids.take(pa.array(by_id))
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ordered), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
            names=schema.names,
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, n = [], [], 0, 0
        for b in batches:
            for first, data, offsets in blocks(b.column(1)):
                doc, term, tf, lengths = _counted(data, offsets)
                if not len(doc):
                    continue
                some = np.flatnonzero(lengths)  # documents without a term have no place in a shard
                local = np.searchsorted(some, doc)
                ids.append(b.column(0).take(pa.array(some + first)))
                parts.append((local + n, term, tf, lengths[doc]))
                n, held = n + len(some), held + len(doc)
                if held >= SHARD_POSTINGS:
                    yield shard(ids, parts)
                    ids, parts, held, n = [], [], 0, 0
        if parts:
            yield shard(ids, parts)

    path = path or fresh_path(spark, "postings")
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if n_docs == 0:
        rows = rows.limit(0)
    # rows are large: the writer is to look at its buffer after each few, and row groups stay small
    sized = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 8, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 2, "parquet.enable.dictionary": "false"}
    rows.mapInArrow(build, schema).write.options(**sized).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to, out.corpus = path, (n_docs, total)
    return out


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: the different terms of each item, as hashes; rows that share an id are one item. Written, as its size is asked for."""
    small_batches(items.sparkSession)
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("term", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in blocks(b.column(1)):
                doc, term, _, _ = _counted(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + first)), pa.array(term)], names=schema.names)

    return written(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(scan, schema).distinct(), "query-terms")


def _lookup(row: dict, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the wanted terms (ascending) a shard has, with the begin and end of their postings."""
    terms, starts = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["starts"], np.int32)
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    have = np.flatnonzero(terms[at] == wanted)
    return have, starts[at[have]], starts[at[have] + 1]


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Over all shards, the number of documents that hold each wanted term; a task returns a row a term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), dtype=np.int64)
        for b in batches:
            for row in b.to_pylist():
                have, low, high = _lookup(row, wanted)
                df[have] += high - low
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["at", "df"])

    out = np.zeros(len(wanted), dtype=np.int64)
    with batch_rows(index.sparkSession, SHARDS_AT_ONCE):
        for r in index.select("terms", "starts").mapInArrow(count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
            out[r["at"]] = r["df"]
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of those that equal the lowest of them, the first ones."""
    some = np.flatnonzero(scores)
    if len(some) <= k:
        return some
    found = scores[some]
    least = found[np.argpartition(found, len(found) - k)[len(found) - k]]
    above = some[found > least]
    return np.concatenate((above, some[found == least][: k - len(above)]))


def _best_of_task(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows (item, score, doc_id) of every item, ties by ascending id, null ids last."""
    order = pc.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")
    rows = rows.take(order)
    item = rows["item"].to_numpy()
    begin = np.searchsorted(item, item, side="left")
    return rows.filter(pa.array(np.arange(len(item)) - begin < k))


def score_block(index: DataFrame, items: list[tuple[object, np.ndarray]], item_type: T.DataType, k: int) -> DataFrame:
    """item_id, doc_id, score: of every task that read shards, the k best documents of every item of a block. Written."""
    n_docs, _ = index.corpus
    spark = index.sparkSession
    wanted = np.unique(np.concatenate([terms for _, terms in items]))
    df = document_frequencies(index, wanted)
    weights = np.array([weight(int(x), n_docs) if x else 0 for x in df], dtype=np.int64)
    places = [np.searchsorted(wanted, terms) for _, terms in items]
    names = pa.array([i for i, _ in items], to_arrow_type(item_type))
    id_type = index.schema["ids"].dataType.elementType
    id_arrow = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType()), T.StructField("task", T.IntegerType())])
    layout = pa.schema([("item", pa.int32()), ("score", pa.int64()), ("doc_id", id_arrow)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            for at in range(b.num_rows):
                row = {n: b.column(n)[at].as_buffer() for n in ("terms", "starts", "docs", "impacts")}
                ids = b.column("ids")[at].values
                docs, impacts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["impacts"], np.int32)
                low, high = np.zeros((2, len(wanted)), dtype=np.int64)
                have, low[have], high[have] = _lookup(row, wanted)
                for i, terms in enumerate(places):
                    acc = np.zeros(len(ids), dtype=np.int64)
                    for t in terms[high[terms] > low[terms]]:
                        acc[docs[low[t] : high[t]]] += weights[t] * impacts[low[t] : high[t]]
                    top = best(acc, k)
                    if len(top):
                        held.append(pa.Table.from_arrays([pa.array(np.full(len(top), i, np.int32)), pa.array(acc[top]), ids.take(pa.array(top))], schema=layout))
            if sum(map(len, held)) >= HELD:
                held = [_best_of_task(pa.concat_tables(held), k)]
        if held:
            rows = _best_of_task(pa.concat_tables(held), k)
            task = pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32))
            whole = pa.Table.from_arrays([names.take(rows["item"].combine_chunks()), rows["doc_id"], rows["score"], task], names=schema.names)
            yield from whole.combine_chunks().to_batches()

    with batch_rows(spark, SHARDS_AT_ONCE):
        return written(index.select("ids", "terms", "starts", "docs", "impacts").mapInArrow(score, schema), "best")


def search(index: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item over all shards, scores above 0 only.

    Equal scores are ranked by ascending id, null ids last. Items without a term that occurs,
    null texts among them, have no row; rows of one item id count as one item with all their terms.
    A null item id is an item like others. Queries are taken in blocks of bounded numbers of items and terms,
    each of which reads the index twice; every block meets every shard.
    """
    spark = items.sparkSession
    terms = query_terms(items, item_id, text)
    kind = terms.schema["item_id"].dataType
    n_items, n_terms = terms.agg(F.count_distinct(F.struct("item_id")), F.count(F.lit(1))).first()
    n_blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-n_terms // BLOCK_TERMS))
    out = None
    for block in range(n_blocks):
        part = terms if n_blocks == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        found = [(r["item_id"], np.array(r["terms"], dtype=np.int64)) for r in part.groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()]
        if not found or not index.corpus[0]:
            continue
        rows = score_block(index, found, kind, k)
        out = rows if out is None else out.union(rows)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType()), T.StructField("task", T.IntegerType())]))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item_id", F.col("task") % 64).orderBy(*order)  # an item's rows from very many tasks meet in two steps
    out = out.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of every benchmark item; see `search` and `build_index` for nulls, repeated rows, ties and empty tables."""
    return search(build_index(docs), items, k)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
l AS (SELECT r, count(*) AS n FROM d GROUP BY r),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l),
f AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM d GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY t, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN f USING (t) JOIN l USING (r), c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""
