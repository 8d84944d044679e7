"""Many keywords found in one scan of a text: an Aho-Corasick automaton as arrays, run over many pieces of texts at once.

The automaton is built once, of a bounded vocabulary, and goes to the tasks with
the function. A task joins the texts of an Arrow batch, cuts what it has into pieces of
equal length, each begun a longest keyword early, and steps all pieces together:
one numpy call for each character of a piece, however many texts there are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mentions
from .clauses import ANNEX_NAME, FLAGS, NEGATIONS, SPECIALIST

#: Stands between texts; no keyword may have it.
SEPARATOR = "￿"
#: Cells of one automaton's table (128 MB); a larger vocabulary is dealt to several automata, each of which scans.
CELLS = 1 << 25
#: Characters that are scanned at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: Characters of the names that the driver takes at once; larger vocabularies are scanned for in parts.
VOCABULARY = 1 << 22


class Automaton:
    """step[state, symbol] is the next state; states from `ending` on (in order) end keywords, listed in `words[first[s]:first[s + 1]]`."""

    def __init__(self, words: Sequence[str]):
        self.symbols = sorted({c for w in words for c in w})
        number = {c: i + 1 for i, c in enumerate(self.symbols)}  # 0 is any other character
        children: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for k, w in enumerate(words):
            s = 0
            for c in w:
                if (to := children[s].get(number[c])) is None:
                    to = children[s][number[c]] = len(children)
                    children.append({})
                    own.append([])
                s = to
            own[s].append(k)
        self.step = np.zeros((len(children), len(self.symbols) + 1), dtype=np.int32)
        fail = [0] * len(children)
        found: list[list[int]] = [[] for _ in children]
        open_ = deque([0])
        while open_:
            s = open_.popleft()
            if s:
                self.step[s] = self.step[fail[s]]
                found[s] = own[s] + found[fail[s]]
            for c, to in children[s].items():
                fail[to] = int(self.step[fail[s], c]) if s else 0
                open_.append(to)
            for c, to in children[s].items():
                self.step[s, c] = to
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        self.words = np.array([k for x in found for k in x], dtype=np.int64)

    def run(self, codes: np.ndarray, reach: int, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last character, keyword) of every occurrence; `reach` is the length of the longest keyword."""
        table = np.zeros(0x110000, dtype=np.int32)
        table[[ord(c) for c in self.symbols]] = np.arange(1, len(self.symbols) + 1)
        pieces = -(-len(codes) // width)
        symbol = np.zeros((pieces + 1) * width + reach, dtype=np.int32)
        symbol[reach : reach + len(codes)] = table[codes]
        begin = np.arange(pieces) * width
        state, flat, row = np.zeros(pieces, dtype=np.int64), self.step.ravel(), self.step.shape[1]
        ends = np.diff(self.first) > 0
        places, states = [], []
        for t in range(1, reach + width):  # a piece begins reach - 1 characters before its own
            state = flat[state * row + symbol[begin + t]].astype(np.int64)
            if t >= reach and (hit := np.flatnonzero(ends[state])).size:
                places.append(begin[hit] + t - reach)
                states.append(state[hit])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, state = np.concatenate(places), np.concatenate(states)
        n = self.first[state + 1] - self.first[state]
        at = np.repeat(self.first[state], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place, n), self.words[at]


@dataclass
class Found:
    """Occurrences in one block of texts, by text and place: codes has the characters of the block, with a separator around each text."""

    first: int
    codes: np.ndarray
    begin: np.ndarray
    text: np.ndarray
    word: np.ndarray
    place: np.ndarray


class Matcher:
    """All occurrences, overlapping ones too, of every word of a list in texts."""

    def __init__(self, words: Sequence[str]):
        if any(not w or SEPARATOR in w for w in words):
            raise ValueError("a keyword has at least one character, and no U+FFFF")
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.parts: list[tuple[np.ndarray, Automaton]] = []
        order = sorted(range(len(words)), key=lambda k: words[k])  # neighbours share states
        while order:
            n, states, symbols = 0, 1, set()
            while n < len(order):
                w = words[order[n]]
                symbols |= set(w)
                states += len(w)
                if n and states * (len(symbols) + 1) > CELLS:
                    break
                n += 1
            part, order = order[:n], order[n:]
            self.parts.append((np.array(part), Automaton([words[k] for k in part])))

    def find(self, texts: Sequence[str | None]) -> Iterator[Found]:
        """Occurrences of consecutive blocks of texts; null is empty. Places are code points from the text's first."""
        first = 0
        while first < len(texts):
            block, size, last = [], 0, first
            while last < len(texts) and (last == first or size < BLOCK):
                block.append((texts[last] or "").replace(SEPARATOR, " "))
                size += len(block[-1]) + 1
                last += 1
            codes = np.frombuffer((SEPARATOR + SEPARATOR.join(block) + SEPARATOR).encode("utf-32-le"), dtype=np.uint32)
            begin = np.cumsum([1] + [len(t) + 1 for t in block])[:-1]
            place, word = [], []
            for names, automaton in self.parts:
                end, k = automaton.run(codes, int(self.length[names].max()))
                word.append(names[k])
                place.append(end + 1 - self.length[names[k]])
            word, place = np.concatenate(word or [np.empty(0, np.int64)]), np.concatenate(place or [np.empty(0, np.int64)])
            text = np.searchsorted(begin, place, side="right") - 1
            order = np.lexsort((word, place))
            yield Found(first, codes, begin, text[order], word[order], place[order])
            first = last


def collected(texts: pd.Series) -> list[str | None]:
    return [x if isinstance(x, str) else None for x in texts]


def mentioned(variants: Sequence[tuple[str, str]]):
    """A function of a lower-case text: the names, in order, of which a variant stands there with no letter a-z beside it."""
    words, names = sorted({v for v, _ in variants}), sorted({n for _, n in variants})
    of_word, of_name = {w: i for i, w in enumerate(words)}, {n: i for i, n in enumerate(names)}
    pairs = np.array(sorted({(of_word[v], of_name[n]) for v, n in variants}), dtype=np.int64).reshape(-1, 2)
    matcher = Matcher(words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scan(texts: pd.Series) -> pd.Series:
        rows = collected(texts)
        out: list[set[int]] = [set() for _ in rows]
        for f in matcher.find(rows):
            letter = (f.codes >= ord("a")) & (f.codes <= ord("z"))
            whole = ~letter[f.place - 1] & ~letter[f.place + matcher.length[f.word]]
            for text, word in np.unique(np.stack((f.text[whole], f.word[whole])), axis=1).T:
                low, high = np.searchsorted(pairs[:, 0], (word, word + 1))
                out[f.first + text].update(pairs[low:high, 1].tolist())
        return pd.Series([[names[i] for i in sorted(x)] for x in out])

    return scan


def mention_scan(docs: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key, name: which names a text mentions, from one scan of each text and without a shuffle of words.

    A name is mentioned if its base form, with hyphens or without, of six characters
    or more, stands in the lower-case text with no letter a-z beside it. Other than
    `mentions.mention_matrix` it also finds names without any letter a-z. The names make
    automata of at most VOCABULARY characters; more names are more scans. Null texts
    mention nothing, and repeated rows of a key count once.
    """
    listed = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    size = listed.agg(F.sum(F.length("name"))).first()[0] or 0
    n = max(1, -(-size // VOCABULARY))
    parts = []
    for k in range(n):
        part = listed.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k)
        rows = part.select("name", F.explode(mentions.variants(F.col("name"))).alias("v")).where(F.length("v") >= mentions.LEAST).collect()
        scan = mentioned([(r["v"], r["name"]) for r in rows])
        parts.append(docs.select(F.col(key), F.explode(scan(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias(name)))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.distinct()


def _without_overlaps(place: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Of one word's occurrences, those that a search that goes on behind each one finds."""
    keep, free, last = np.zeros(len(place), dtype=bool), -1, -1
    for i, (p, t) in enumerate(zip(place, text, strict=True)):
        if t != last or p >= free:
            keep[i], free, last = True, p + length, t
    return keep


def flag_scan(flags: dict[str, Sequence[str]] = FLAGS, negations: Sequence[str] = NEGATIONS, around: int = 22, reach: int = 6):
    """A function of a text: for each flag (kw, pos, quote) of the first occurrence that no negator voids, of the first word that has one.

    Words and negators are found in one scan. A negator voids an occurrence if it stands whole in the `reach` characters before it.
    """
    words = list(dict.fromkeys([*(w for ws in flags.values() for w in ws), *negations]))
    number = {w: i for i, w in enumerate(words)}
    matcher = Matcher(words)
    against = sorted({len(n) for n in negations if len(n) <= reach})
    is_against = np.array([w in set(negations) for w in words])
    overlaps = [any(w.startswith(w[i:]) for i in range(1, len(w))) for w in words]
    evidence = T.StructType([T.StructField("kw", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("quote", T.StringType())])
    schema = T.StructType([T.StructField(f, evidence) for f in flags])

    @F.pandas_udf(schema)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = collected(texts)
        out = {f: [None] * len(rows) for f in flags}
        for found in matcher.find(rows):
            neg = {n: found.place[is_against[found.word] & (matcher.length[found.word] == n)] for n in against}
            low = np.maximum(found.place - reach, found.begin[found.text])
            void = np.zeros(len(found.place), dtype=bool)
            for n, at in neg.items():  # is there a negator of n characters that begins from low on and ends before the word
                void |= np.searchsorted(at, found.place - n, side="right") > np.searchsorted(at, low, side="left")
            for f, ws in flags.items():
                for w in ws:
                    mine = found.word == number[w]
                    place, text, good = found.place[mine], found.text[mine], ~void[mine]
                    if overlaps[number[w]]:
                        good &= _without_overlaps(place, text, len(w))
                    text, place = text[good], place[good]
                    new, at = np.unique(text, return_index=True)
                    for t, p in zip(new, place[at], strict=True):
                        row = found.first + int(t)
                        if out[f][row] is None:
                            pos = int(p - found.begin[t])
                            quote = rows[row][max(pos - around, 0) : pos + len(w) + around].replace("\n", " ").strip()
                            out[f][row] = {"kw": w, "pos": pos, "quote": quote}
        return pd.DataFrame(out, columns=list(flags))

    return scan


def extract_flags_scan(docs: DataFrame, text: str, flags: dict[str, Sequence[str]] = FLAGS, negations: Sequence[str] = NEGATIONS) -> DataFrame:
    """`docs` with the columns of `clauses.extract_flags`, keywords and negators from one scan of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__found", flag_scan(flags, negations)(t))
    for name in flags:
        out = out.withColumn(f"{name}_ev", F.col("__found")[name]).withColumn(name, F.col(f"{name}_ev").isNotNull())
    out = out.drop("__found").withColumn("specialist_only", F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(SPECIALIST), 1))))
    return out.withColumn("attachments", F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(ANNEX_NAME), 0))))


def keyword_counts(words: Sequence[str]):
    """A function of a text: how often each word occurs, overlapping occurrences counted, in the order of `words`."""
    matcher = Matcher(words)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def scan(texts: pd.Series) -> pd.Series:
        rows = collected(texts)
        out = np.zeros((len(rows), len(words)), dtype=np.int64)
        for f in matcher.find(rows):
            np.add.at(out, (f.first + f.text, f.word), 1)
        return pd.Series(list(out))

    return scan
