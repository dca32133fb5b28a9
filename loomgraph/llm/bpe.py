"""Byte-level BPE encoding and decoding by merge ranks.

A piece starts as single bytes.  A segment tree over its byte positions holds,
at every node, the smallest (rank, position) of the adjacent pairs below, so
its root is the leftmost pair of lowest rank.  A merge links the second token
out and changes at most three leaves - the merged token, the token that went,
the left neighbour -, each updated up its path.  A piece of n bytes thus takes
O(n log n) steps whatever its length.  The short pieces of a batch of texts
that are new are merged side by side: one row of trees each, one merge of every
piece a step, in NumPy; longer ones one by one.

Ranks are read on the driver and broadcast: a vocabulary is a bounded file.
Texts never move between tasks; there is no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices
from loomgraph.llm.pieces import PieceEncoder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# Longest piece, in bytes, that is merged side by side with others.
SIDE_BY_SIDE = 64

_NONE = 1 << 62
_PLACE = 40
_PLACES = (1 << _PLACE) - 1


@lru_cache(maxsize=2)
def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def merge(tokens: list[int], order: dict[int, int], merged: Sequence[int]) -> list[int]:
    """Token ids of one piece: the leftmost pair of lowest rank merges until none has a rank.

    ``order`` gives the rank of a pair (first id in the upper 32 bits), ``merged`` the id that a rank makes.
    """
    n = len(tokens)
    tokens = list(tokens)
    after = list(range(1, n + 1))
    before = list(range(-1, n))

    def pair(i: int) -> int:
        """Tree value of the token at ``i`` and its right neighbour."""
        j = after[i]
        rank = order.get((tokens[i] << 32) | tokens[j]) if j < n else None
        return _NONE if rank is None else (rank << _PLACE) | i

    size = 1 << max(0, n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pair(i)
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(i: int, value: int) -> None:
        node = size + i
        if tree[node] == value:
            return
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] < _NONE:
        i = tree[1] & _PLACES
        gone = after[i]
        tokens[i] = int(merged[tree[1] >> _PLACE])
        after[i] = after[gone]
        before[after[gone]] = i
        put(gone, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(tokens[i])
        i = after[i]
    return out


class Merger:
    """Packed ids (little-endian, 32 bits) of many pieces."""

    def __init__(self, byte: Sequence[int], order: dict[int, int], merged: Sequence[int], whole: dict[bytes, int]):
        """``byte`` has the id of every byte; pieces in ``whole`` are one token without any merge."""
        self._byte, self._order, self._whole = np.array(byte, np.int64), order, whole
        self._merged = np.array(merged, np.int64)
        self._pairs = np.array(sorted(order), np.int64)
        self._ranks = np.array([order[k] for k in sorted(order)], np.int64)

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merger:
        """Pairs of tokens merge where their bytes together are a token; its id is the pair's rank."""
        order = {
            (left << 32) | right: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        }
        return cls([ranks[bytes([i])] for i in range(256)], order, range(max(ranks.values()) + 1), ranks)

    def _values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree values of token pairs."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, (self._ranks[at] << _PLACE) | place, _NONE)

    def _side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of 1 to ``size`` bytes, a power of two; as ``merge``, with arrays of one row a piece, laid flat."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        token = self._byte[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)]
        place = np.tile(np.arange(size), n)
        alive = place < np.repeat(length, size)
        after = place + 1
        before = np.tile(np.arange(-1, size), n)
        tree = np.full((n, 2 * size), _NONE, np.int64)
        ok = place + 1 < np.repeat(length, size)
        leaves = np.full(n * size, _NONE, np.int64)
        spot = np.flatnonzero(ok)
        leaves[spot] = self._values(token[spot], token[spot + 1], place[spot])
        tree[:, size:] = leaves.reshape(n, size)
        width = size // 2
        while width:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width //= 2
        tree = tree.reshape(-1)

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
            base, node = row * (2 * size), size + i
            tree[base + node] = value
            while node[0] > 1:
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])

        row = np.arange(n)
        while True:
            root = tree[row * (2 * size) + 1]
            row, root = row[root < _NONE], root[root < _NONE]
            if not len(row):
                break
            base, i = row * size, root & _PLACES
            gone = after[base + i]
            behind = after[base + gone]
            token[base + i] = self._merged[root >> _PLACE]
            alive[base + gone] = False
            after[base + i] = behind
            before[row * (size + 1) + behind] = i
            put(row, gone, _NONE)
            inside = behind < length[row]
            put(row, i, np.where(inside, self._values(token[base + i], token[base + np.where(inside, behind, i)], i), _NONE))
            left = before[row * (size + 1) + i]
            has = left >= 0
            if has.any():
                put(row[has], left[has], self._values(token[(base + left)[has]], token[(base + i)[has]], left[has]))
        ends = (4 * np.cumsum(alive.reshape(n, size).sum(1))).tolist()
        ids = token[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def __call__(self, names: list[str]) -> list[bytes]:
        raw = [name.encode() for name in names]
        out: list[bytes] = [b""] * len(raw)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(raw):
            whole = self._whole.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > SIDE_BY_SIDE:
                out[k] = np.array(merge(self._byte[list(piece)].tolist(), self._order, self._merged), "<u4").tobytes()
            else:
                classes.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(k)
        for size, members in classes.items():
            for k, packed in zip(members, self._side_by_side([raw[k] for k in members], size)):
                out[k] = packed
        return out


@lru_cache(maxsize=2)
def merger(content: bytes) -> Merger:
    return Merger.of_ranks(read_ranks(content))


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, text: str = "text", id: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(id, ids): every text's token ids, packed as little-endian unsigned 32-bit integers.

    A null or empty text has no tokens; every row is encoded by itself, so
    repeated rows, null ids and any further columns change nothing.  Bytes that
    are no UTF-8 count as U+FFFD.  ``ranks`` must hold every single byte.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_content(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(merger(shared.value))
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            packed = encoder.encode([t.decode("utf-8", "replace") if t else "" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")
    return out.withColumnRenamed("id", id)


def decode(encoded: DataFrame, ids: str = "ids", id: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(id, ids, decoded): the bytes of packed token ids; null ids are none.  An id outside the vocabulary raises."""
    shared = encoded.sparkSession.sparkContext.broadcast(_content(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {rank: token for token, rank in read_ranks(shared.value).items()}
        tokens = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.large_binary())
        for batch in slices(batches, 1):
            packed = batch.column(1).fill_null(b"").to_pylist()
            numbers = np.frombuffer(b"".join(packed), "<u4")
            known = not len(numbers) or int(numbers.max()) < len(tokens)
            taken = pc.take(tokens, pa.array(numbers)) if known else None
            if taken is None or taken.null_count:
                raise ValueError("a token id is not in the vocabulary")
            at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
            ends = np.frombuffer(taken.buffers()[1], np.int64, len(numbers) + 1)[at] if len(numbers) else np.zeros(len(at), np.int64)
            raw = memoryview(taken.buffers()[2]) if len(numbers) else memoryview(b"")
            out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(bytes, out), pa.binary())], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id)


def bpe_report(docs: DataFrame, text: str = "text", id: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """Per row (id, n_tokens, ids_sha256, decoded_sha256); a null or empty text has 0 tokens and the digests of no bytes."""
    both = decode(encode(docs, text, id, ranks), "ids", id, ranks)
    return both.select(
        id, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
