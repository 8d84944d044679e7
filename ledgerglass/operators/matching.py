"""How much of one text stands in another: matching blocks, longest first, through samples and suffix automata.

Between two ranges the longest common block is taken, the earliest in the first
text and then in the second, and the ranges left and right of it are compared in
the same way. Long blocks are found by samples: one of 2 k - 1 characters covers one
of the second range's samples of k, taken every k characters, so that every place of
the samples in the first range, made as long as it gets, gives all longest blocks. Where
blocks are short, or samples occur all over, a suffix automaton of the second range is
run over the first, in time linear in both. All blocks of the greatest length are placed
in one pass, so that what is left of a range only has shorter ones.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dotted numbers, which stand in a text but not in its parts.
CODE_IN_TEXT = re.compile(r"\d+(?:\.\d+)*\.?(?=[^\d])")


class SuffixAutomaton:
    """All substrings of a text; states are classes of substrings that end at the same places."""

    def __init__(self, text: str):
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        step, link, length, last = self.step, self.link, self.length, 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def longest(self, text: str) -> tuple[int, list[int]]:
        """Length of the longest substring of `text` that the automaton's text has, and where each of that length begins."""
        step, link, length = self.step, self.link, self.length
        state = size = most = 0
        places: list[int] = []
        for at, c in enumerate(text):
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            if (to := step[state].get(c)) is not None:
                state, size = to, size + 1
            if size > most:
                most, places = size, []
            if size == most and most:
                places.append(at - most + 1)
        return most, places


#: The shortest samples; blocks that may be shorter than two of them are left to the automaton.
LEAST_SAMPLE = 12
#: Characters that a search for samples may pass, for each that the automaton would read in the same time.
SEARCH_COST = 500


def _alike(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters, up to `most`, are the same from places i and j on."""
    low, step = 0, 16
    while low < most:
        step = min(step, most - low)
        if a[i + low : i + low + step] == b[j + low : j + low + step]:
            low, step = low + step, 2 * step
        elif step == 1:
            break
        else:
            most, step = low + step, max(1, step // 4)
    return low


def _alike_before(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters, up to `most`, are the same right before places i and j."""
    low, step = 0, 16
    while low < most:
        step = min(step, most - low)
        if a[i - low - step : i - low] == b[j - low - step : j - low]:
            low, step = low + step, 2 * step
        elif step == 1:
            break
        else:
            most, step = low + step, max(1, step // 4)
    return low


def _longest_by_samples(a: str, b: str) -> tuple[int, list[int]] | None:
    """As SuffixAutomaton(b).longest(a), or None if samples do not decide it."""
    k = min(len(a), len(b)) // 4
    while k >= LEAST_SAMPLE and len(a) * (len(b) // k) < SEARCH_COST * (len(a) + len(b)):
        size, places, known, left = 0, set(), {}, 64 + 4 * (len(b) // k)
        for s in range(0, len(b) - k + 1, k):
            sample = b[s : s + k]
            p = a.find(sample)
            while p >= 0:
                if known.get(p - s, 0) < p + k:  # not in a block that was found already
                    left -= 1
                    if left < 0:
                        return None
                    begin = p - _alike_before(a, p, b, s, min(p, s))
                    end = p + k + _alike(a, p + k, b, s + k, min(len(a) - p, len(b) - s) - k)
                    known[p - s] = end
                    if end - begin > size:
                        size, places = end - begin, set()
                    if end - begin == size:
                        places.add(begin)
                p = a.find(sample, p + 1)
        if size >= 2 * k - 1:
            return size, sorted(places)
        k //= 2
    return None


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) of the matching blocks, by place; none overlaps another or crosses it."""
    blocks, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (j := b.find(a[a0:a1], b0, b1)) >= 0:
            blocks.append((a0, j, a1 - a0))
            continue
        if (i := a.find(b[b0:b1], a0, a1)) >= 0:
            blocks.append((i, b0, b1 - b0))
            continue
        x, y = a[a0:a1], b[b0:b1]
        size, places = _longest_by_samples(x, y) or SuffixAutomaton(y).longest(x)
        if not size:
            continue
        gone: set[str] = set()  # blocks that the rest of the second range no longer has
        low_a, low_b = a0, b0
        for i in places:
            i += a0
            if i < low_a or (block := a[i : i + size]) in gone:
                continue
            j = b.find(block, low_b, b1)
            if j < 0:
                gone.add(block)
                continue
            blocks.append((i, j, size))
            open_.append((low_a, i, low_b, j))
            low_a, low_b = i + size, j + size
        open_.append((low_a, a1, low_b, b1))
    return sorted(blocks)


def bare(text: str | None) -> str:
    """A text as it is compared: NFKC, without white space, then without dotted numbers that something follows."""
    return CODE_IN_TEXT.sub("", "".join(unicodedata.normalize("NFKC", text or "").split()))


def matched_share(source: str | None, parts: str | None) -> float:
    """Share of the source's bare characters that matching blocks cover in the parts; 1 for a source without any."""
    a, b = bare(source), bare(parts)
    return sum(size for *_, size in matching_blocks(a, b)) / len(a) if a else 1.0


@F.pandas_udf(T.DoubleType())
def coverage(source: pd.Series, parts: pd.Series) -> pd.Series:
    """`matched_share` of each row's two texts, to four digits."""
    return pd.Series([round(matched_share(*x), 4) for x in zip(source, parts, strict=True)], dtype=float)
