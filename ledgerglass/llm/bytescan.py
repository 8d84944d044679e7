"""Vectorised scanning of UTF-8 text inside tasks.

Everything here works on one Arrow column at a time: the bytes of many texts
lie one after another in one numpy array, so words, k-grams and window minima
of thousands of documents take a handful of numpy calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text makes a block of its own.
BLOCK = 1 << 18
U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: A word is a run of digits, letters and everything outside ASCII, after A-Z became a-z.
WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of consecutive texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, pa.scalar("", column.type)).cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n; kept for the next block."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            made = []
            for b in (base, inverse):
                p = np.full(size, b, dtype=U)
                p[0] = 1
                made.append(np.cumprod(p, dtype=U))
        have = (made[0], made[1])
        if size <= 16 * BLOCK:
            _POWERS[base] = have
    return have


class SpanHash:
    """Hashes of any spans of a byte block, after one pass over it."""

    def __init__(self, data: np.ndarray, base: int = 0x2545F4914F6CDD1D):
        up, self.down = powers(base, len(data))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=U)
            np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * _B)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from every position on."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.empty(0, dtype=U)
        with np.errstate(over="ignore"):
            x = (self.sums[k:] - self.sums[:-k]) * self.down[:n]
            x ^= x >> U(32)
            x *= _A
            return x ^ (x >> U(29))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, their 64-bit hashes, and where each text's words begin (and end) among them."""
    low = LOWER[data]
    is_word = WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = is_word
    now = np.append(is_word, False)
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, SpanHash(low)(starts, ends), np.searchsorted(starts, offsets)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, in a few passes whatever the width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width <= 8:
        out = values[:n].copy()
        for i in range(1, width):
            np.minimum(out, values[i : i + n], out=out)
        return out
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def row_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, k):
            out *= _A
            out += hashes[i : i + n]
        return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U else x.astype(np.int64)
