"""Minimal perfect hashing of 64-bit keys, built by shard, asked in NumPy.

A shard's keys are thrown into a bit table; those that land alone own their
bit, the others go on to a smaller table, until all own one.  The number of set
bits before a key's bit is its place: places of n keys are 0..n-1, with about
four bits a key and no key stored.  Keys stored by place tell members from
others ("verified keys").

A shard is the leading bits of a key's scrambled value, so shards are built in
parallel and several of them put together answer as one function.
"""

from __future__ import annotations

import numpy as np

from loomgraph.llm.textcodes import mix

_STEP = 0x9E3779B97F4A7C15
# Bits a key in the first table of a level.
_ROOM = 2


def _spot(h: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return mix(h + np.uint64(_STEP * (level + 1) % (1 << 64))) % np.asarray(size, np.uint64)


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The shard of scrambled keys: their ``bits`` leading bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the levels in 64-bit words, words, keys by place) of one shard's distinct ``keys``."""
    left = mix(keys.astype(np.uint64))
    sizes, words = [], []
    while len(left):
        n_words = -(-_ROOM * len(left) // 64)
        spot = _spot(left, len(sizes), 64 * n_words).astype(np.int64)
        alone = np.bincount(spot, minlength=64 * n_words) == 1
        sizes.append(n_words)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[spot]]
    out = np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)
    table = PairHash([out], 0, 0)
    ordered = np.empty(len(keys), np.uint64)
    ordered[table.places(keys)] = keys.astype(np.uint64)
    return *out, ordered


class PairHash:
    """The function of some neighbouring shards; ``first`` is the number of the first of them."""

    def __init__(self, shards: list[tuple[np.ndarray, np.ndarray]], first: int, bits: int, keys: list[np.ndarray] | None = None):
        self._first, self._bits = first, bits
        depth = max((len(s) for s, _ in shards), default=0)
        self._size = np.zeros((len(shards), depth), np.uint64)
        self._start = np.zeros((len(shards), depth), np.int64)
        base = 0
        for i, (sizes, _) in enumerate(shards):
            self._size[i, : len(sizes)] = 64 * sizes
            self._start[i, : len(sizes)] = 64 * (base + np.cumsum(sizes) - sizes)
            base += int(sizes.sum())
        self._words = np.concatenate([w for _, w in shards]) if shards else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self._words).astype(np.int64)
        self._before = np.cumsum(ones) - ones
        self._keys = np.concatenate(keys) if keys else None

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 for keys that are not members; without stored keys all must be members."""
        out = np.full(len(keys), -1, np.int64)
        h = mix(keys.astype(np.uint64))
        shard = shard_of(h, self._bits) - self._first
        at = np.flatnonzero((shard >= 0) & (shard < len(self._size)))
        h, shard = h[at], shard[at]
        for level in range(self._size.shape[1]):
            size = self._size[shard, level]
            on = size > 0
            at, h, shard, size = at[on], h[on], shard[on], size[on]
            if not len(at):
                break
            spot = self._start[shard, level] + _spot(h, level, size).astype(np.int64)
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            value = self._words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value & ((np.uint64(1) << bit) - np.uint64(1))
            out[at[hit]] = (self._before[word] + np.bitwise_count(below))[hit]
            at, h, shard = at[~hit], h[~hit], shard[~hit]
        if self._keys is not None:
            inside = out >= 0
            out[inside] = np.where(self._keys[out[inside]] == keys[inside].astype(np.uint64), out[inside], -1)
        return out
