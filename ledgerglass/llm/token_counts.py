"""Token counts of texts by byte-pair merging, without making any token.

The vocabulary gives the rank of every string that two neighbours may merge
into. A text's symbols - its characters - are a linked list; a heap holds the
neighbours by rank, leftmost first among equals; the lowest is popped and
merged until none is left. The count is the initial symbols minus the merges.
A character that is no piece counts as its UTF-8 bytes.

Two neighbouring characters that stand together in no piece never merge, so a
text may be cut between them without changing its count. Cut where a space, or
another kind of character begins, texts become words, and a word that was
counted before by the same Python worker is looked up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: The sign that stands for a space.
SPACE = "▁"
#: Words that a Python worker remembers, in two generations, and the longest of them: at most 200 MB.
KEPT_WORDS, KEPT_LENGTH = 1 << 20, 64


@dataclass(frozen=True)
class Merges:
    """ranks: of each piece, lower first. prefix: whether a space is put before a text that is not empty. key: differs between vocabularies."""

    ranks: dict[str, int]
    prefix: bool
    key: str

    def pattern(self) -> re.Pattern:
        """Finds parts of a text between which no merge is possible.

        Characters that stand together in a piece, directly or through others, are of
        one kind (spaces aside). The two largest kinds, which are letters and signs in a
        vocabulary of words, are told from each other and from the rest.
        """
        joined = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        if any(b == SPACE and a != SPACE for a, b in joined):
            return re.compile(r"(?s:.+)")  # a piece may go on behind a space
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while (up := kind.setdefault(c, c)) != c:
                kind[c] = c = kind[up]
            return c

        for a, b in joined:
            if SPACE not in (a, b):
                kind[root(a)] = root(b)
        members: dict[str, str] = {}
        for c in sorted(kind):
            members[root(c)] = members.get(root(c), "") + c
        large = [re.escape(x) for x in sorted(members.values(), key=len)[-2:]]
        runs = "|".join([f"[{x}]+" for x in large] + [f"[^{SPACE}{''.join(large)}]+"])
        return re.compile(f"{SPACE}+(?:{runs})?|{runs}")


def load_merges(path: str) -> Merges:
    """Ranks from a sentencepiece BPE model: pieces by falling score, equal scores having equal ranks.

    Models with a character map, with user-defined pieces or that remove white space
    are refused: their texts change before they are merged.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        data = f.read()
    model.ParseFromString(data)
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    norm = model.normalizer_spec
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or not plain or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only BPE with byte fallback over unchanged texts is counted")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: user-defined or unused pieces are not counted")
    scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    place = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
    return Merges({p: place[s] for p, s in scores.items()}, bool(norm.add_dummy_prefix), hashlib.sha256(data).hexdigest())


def count_part(text: str, ranks: dict[str, int]) -> int:
    """Symbols that are left of `text`, which is not empty, when no neighbours can merge any more."""
    n = len(text)
    extra = [0 if c in ranks else len(c.encode()) - 1 for c in text]
    count = n + sum(extra)
    if n == 1:
        return count
    # symbol i is text[i:end[i]], the next one begins at end[i]; a symbol that was merged into its neighbour ends at 0
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not i < j < stop or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        count -= 1 + extra[i] + extra[j]
        extra[i] = extra[j] = 0
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(text[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(text[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    return count


class Counter:
    """Counts texts and remembers words."""

    def __init__(self, merges: Merges):
        self.merges, self.find, self.known, self.older = merges, merges.pattern().findall, {}, {}

    def miss(self, part: str) -> int:
        n = self.older.get(part) or count_part(part, self.merges.ranks)
        if len(part) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_WORDS // 2:
                self.known, self.older = {}, self.known
            self.known[part] = n
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        parts = self.find((SPACE if self.merges.prefix else "") + text.replace(" ", SPACE))
        counts = list(map(self.known.get, parts))
        for i, n in enumerate(counts):
            if n is None:
                counts[i] = self.known.get(parts[i]) or self.miss(parts[i])
        return sum(counts)


_counters: dict[str, Counter] = {}


def worker_counter(merges: Merges) -> Counter:
    """This process's counter for a vocabulary; Spark uses a Python worker for many tasks."""
    if merges.key not in _counters:
        _counters.clear()
        _counters[merges.key] = Counter(merges)
    return _counters[merges.key]


def token_counts(docs: DataFrame, merges: Merges, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, with n_bytes (UTF-8) and n_tokens of its whole text; null is empty and has 0 of both.

    Columns that are not asked for are ignored, whatever their names. A repeated row is counted
    again, null ids stay null, and an empty table gives none. Memory grows with one text, not with a table:
    about 100 bytes for each character of a part without a space, else a few for each character of the text.
    """
    small_batches(docs.sparkSession)
    if {"n_bytes", "n_tokens"} & set(keep):
        raise ValueError("n_bytes and n_tokens are the result's own columns")
    fields = [docs.schema[k] for k in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(merges)
        for b in batches:
            texts = pc.fill_null(b.column(len(fields)), "")
            tokens = pa.array([counter(x.as_py()) for x in texts], pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(fields))), size, tokens], names=[*keep, "n_bytes", "n_tokens"])

    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*(F.col(k) for k in keep), F.col(text).alias("__text")).mapInArrow(count, schema)


def digest(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row of `documents`."""
    return token_counts(docs, load_merges(path)).withColumn("over_limit", F.col("n_tokens") > limit)
