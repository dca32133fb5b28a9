"""Words, lines and their hashes straight from Arrow text buffers, in NumPy.

Whitespace and A-Z are ASCII, so everything works on UTF-8 bytes.  A batch is
taken in blocks of about ``BLOCK`` bytes; a longer text is a block of its own.
A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 9 << 15

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_BYTE_LOWER = _BYTE[_LOWER]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def chain(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return chain(_R), chain(pow(_R, -1, 1 << 64))


class Block:
    """Some texts in a row: ``data`` (bytes), ``starts`` and ``ends`` in it, ``first`` (number of the first text in its batch)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)

    def pieces(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of the maximal runs where ``inside`` holds; runs end with their text."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        edge[self.ends] = True
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        begin = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:], after[:-1] = False, inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        text = np.searchsorted(self.starts, begin, "right") - 1
        good = begin < self.ends[text] if len(begin) else np.zeros(0, bool)
        return begin[good], end[good], text[good]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.pieces(~_SPACE[self.data])

    def hashes(self, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
        """64-bit hash of every piece, A-Z folded: a polynomial over scrambled bytes, scrambled with the length."""
        if not len(begin):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        size = 1 << max(19, int(n).bit_length())
        up, down = _powers(size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * up[:n], out=total[1:])
        raw = (total[end] - total[begin]) * down[begin]
        return mix(raw ^ (np.uint64(_R) * (end - begin).astype(np.uint64)))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow string array, a block of about ``size`` bytes at a time."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        none = column.is_null().to_numpy(zero_copy_only=False)
        ends[none] = starts[none]
    first = 0
    while first < n:
        stop = int(np.searchsorted(ends, starts[first] + size, "right"))
        stop = min(n, max(stop, first + 1))
        low = int(starts[first])
        yield Block(raw[low : int(at[stop])], starts[first:stop] - low, ends[first:stop] - low, first)
        first = stop


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every run of ``size`` words inside one text; the place is that of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.flatnonzero(text[:n] == text[size - 1 :])
    out = np.zeros(len(place), np.uint64)
    for j in range(size):
        out = out * np.uint64(_R) + hashes[place + j]
    return place, mix(out + np.uint64(size))


def sums(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n)
