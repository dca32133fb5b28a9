"""Elias-Fano sequences and an n-gram trie of up to three levels in one memory-mapped file."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_ONES = _BITS.sum(1).astype(np.uint8)
#: Place of the (i + 1)-th set bit of every byte.
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A nondecreasing sequence: low bytes kept as they are, high parts in unary.

    Number i with high part h is bit h + i of the upper bits, so both together
    take about two bits a number more than the low part.  The low part's width
    is a whole number of bytes.  The upper bits stay packed; a count of set bits
    before every 64 of them serves rank and select.
    """

    def __init__(self, n: int, width: int, upper: np.ndarray, low: np.ndarray):
        self.n, self.width, self.low = n, width, low
        self.upper = upper.reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(_ONES[self.upper].sum(1, dtype=np.int64))])
        self.zeros = 64 * len(self.upper) - int(self.before[-1])

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        need = max(0, (max(universe, 1) // max(n, 1)).bit_length())
        width = -(-need // 8)
        high = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        size = (int(high[-1]) if n else 0) + n + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        return n, width, np.packbits(bits), np.ascontiguousarray(low)

    def _select(self, k: np.ndarray, zero: bool = False) -> np.ndarray:
        """Place of the k-th set (or clear) bit, counted from 0."""
        before = 64 * np.arange(len(self.before)) - self.before if zero else self.before
        word = np.searchsorted(before, k, "right") - 1
        rest = k - before[word]
        held = self.upper[word]
        if zero:
            held = ~held
        upto = np.cumsum(_ONES[held], axis=1, dtype=np.uint8)
        byte = (upto <= rest[:, None]).sum(1)
        at = np.arange(len(k))
        rest = rest - np.where(byte > 0, upto[at, byte - 1], 0)
        return word * 64 + byte * 8 + _PLACE[held[at, byte], rest]

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part of at most ``high``."""
        return self._select(high, zero=True) - high

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(self.width):
            out |= self.low[at, j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at) - at).astype(np.uint64)
        return (high << np.uint64(8 * self.width)) | self._low(at)

    def find(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, searched between ``lo`` and ``hi`` where given, or -1."""
        high = (values >> np.uint64(8 * self.width)).astype(np.int64)
        top = self.zeros
        a = np.where(high > 0, self._upto(np.clip(high - 1, 0, top - 1)), 0)
        b = np.where(high < top, self._upto(np.clip(high, 0, top - 1)), a)
        a = np.where(high <= top, a, b)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        end = b.copy()
        want = values & np.uint64((1 << (8 * self.width)) - 1)
        while (live := np.flatnonzero(a < b)).size:
            mid = (a[live] + b[live]) // 2
            less = self._low(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
        found = a < end
        found[found] = self._low(a[found]) == want[found]
        return np.where(found, a, -1)


def quantise(x: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(code of every number, value of every code): codes are equal steps of the range, their values the means of what they stand for."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1)
    seen = np.unique(x)
    if len(seen) > levels:
        edges = np.linspace(seen[0], seen[-1], levels + 1)[1:-1]
        code = np.searchsorted(edges, x, "right")
        size = np.bincount(code, minlength=len(edges) + 1)
        value = np.bincount(code, weights=x, minlength=len(edges) + 1) / np.maximum(size, 1)
        return code.astype(np.uint8), value
    return np.searchsorted(seen, x).astype(np.uint8), seen


class Trie:
    """Contexts, their pointers, their successors and quantised log10 weights.

    ``context`` are sorted ids with counts; ``row`` and ``follower`` name the
    seen pairs, sorted.  A successor of one word is its rank in the shard's
    vocabulary, made monotone by adding context rank x vocabulary size.

    With a third level, ``pair`` and ``past`` name the seen triples (place of
    the pair, id of the word before it).  Their contexts are (word, word before)
    and a successor is its place among the successors of the shorter context,
    made monotone by the summed lengths of those lists.
    """

    def __init__(
        self,
        context: np.ndarray,
        count: np.ndarray,
        row: np.ndarray,
        follower: np.ndarray,
        log_p: np.ndarray,
        backoff: np.ndarray,
        pair_backoff: np.ndarray | None = None,
        pair: np.ndarray | None = None,
        past: np.ndarray | None = None,
        weight: np.ndarray | None = None,
    ):
        vocab = np.unique(follower)
        self.size = max(1, len(vocab))
        rank = np.searchsorted(vocab, follower).astype(np.uint64)
        pointer = np.searchsorted(row, np.arange(len(context) + 1)).astype(np.uint64)
        joined = row.astype(np.uint64) * np.uint64(self.size) + rank
        code, self.value = quantise(log_p)
        back, self.back_value = quantise(backoff)
        levels = [(context, 1 << 48), (pointer, len(row) + 1), (vocab, 1 << 48), (joined, max(1, len(context)) * self.size)]
        flat = [code, back, np.ascontiguousarray(count.astype("<i8")).view(np.uint8)]
        self.deep = pair is not None
        if self.deep:
            pasts = np.unique(past)
            self.n_past = max(1, len(pasts))
            owner = row[pair]
            key = owner.astype(np.uint64) * np.uint64(self.n_past) + np.searchsorted(pasts, past).astype(np.uint64)
            history, of = np.unique(key, return_inverse=True)
            size = np.diff(pointer.astype(np.int64))[(history // np.uint64(self.n_past)).astype(np.int64)]
            base = np.concatenate([[0], np.cumsum(size)]).astype(np.uint64)
            successor = base[of] + (pair - pointer[owner].astype(np.int64)).astype(np.uint64)
            order = np.argsort(successor)
            deep_pointer = np.searchsorted(of[order], np.arange(len(history) + 1)).astype(np.uint64)
            top = int(base[-1]) + 1
            levels += [(pasts, 1 << 48), (history, max(1, len(context)) * self.n_past), (base, top), (deep_pointer, len(pair) + 1), (successor[order], top)]
            deep_code, self.deep_value = quantise(weight[order])
            pair_back, self.pair_back_value = quantise(pair_backoff)
            flat += [deep_code, pair_back]
        coded = [EliasFano.encode(*x) for x in levels]
        parts = [x for _, _, upper, low in coded for x in (upper, low.ravel())] + flat
        handle, path = tempfile.mkstemp(prefix="trie-")  # scratch of this task
        with os.fdopen(handle, "wb") as f:
            for p in parts:
                f.write(p.tobytes())
        whole = np.memmap(path, np.uint8, "r") if sum(map(len, parts)) else np.zeros(0, np.uint8)
        os.unlink(path)  # the mapping stays until it is dropped; nothing is left behind
        self.bytes = len(whole)
        edge = np.cumsum([0, *map(len, parts)])
        cut = [whole[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        made = [EliasFano(n, w, cut[2 * i], cut[2 * i + 1].reshape(n, w)) for i, (n, w, _, _) in enumerate(coded)]
        self.context, self.pointer, self.vocab, self.successor = made[:4]
        rest = cut[2 * len(made) :]
        self.code, self.back, self.count = rest[0], rest[1], np.frombuffer(rest[2].tobytes(), "<i8")
        if self.deep:
            self.past, self.history, self.base, self.deep_pointer, self.deep_successor = made[4:]
            self.deep_code, self.pair_back = rest[3], rest[4]

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        return self.context.find(ids)

    def pairs(self, row: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Place of each (context rank, successor), or -1: a search inside the context's own successors."""
        out = np.full(len(row), -1, np.int64)
        word = self.vocab.find(follower)
        ask = np.flatnonzero((row >= 0) & (word >= 0))
        if len(ask):
            r = row[ask]
            lo, hi = (self.pointer.access(r + i).astype(np.int64) for i in (0, 1))
            key = r.astype(np.uint64) * np.uint64(self.size) + word[ask].astype(np.uint64)
            out[ask] = self.successor.find(key, lo, hi)
        return out

    def triples(self, row: np.ndarray, pair: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Place of each (context rank, place of the pair, word before), or -1: the pair's place among the shorter context's
        successors is looked for among those of the longer one."""
        out = np.full(len(row), -1, np.int64)
        before = self.past.find(past)
        ask = np.flatnonzero((pair >= 0) & (before >= 0))
        if len(ask):
            r = row[ask]
            history = self.history.find(r.astype(np.uint64) * np.uint64(self.n_past) + before[ask].astype(np.uint64))
            ask, r, history = ask[history >= 0], r[history >= 0], history[history >= 0]
        if len(ask):
            lo, hi = (self.deep_pointer.access(history + i).astype(np.int64) for i in (0, 1))
            place = pair[ask].astype(np.uint64) - self.pointer.access(r)
            out[ask] = self.deep_successor.find(self.base.access(history) + place, lo, hi)
        return out
