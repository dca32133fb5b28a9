"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked token ids.

1. Every text is encoded by both vocabularies once; the ids are kept, packed.
2. Both id rows are laid over the text's bytes.  Offsets where tokens of both
   end cut them into groups; the two tokens that end there are a link.
3. The distinct linked id pairs get a minimal perfect hash, built by shard.
4. Every task adds its links into a dense vector by place and the vectors are
   summed as a tree.
5. The kept ids are aligned again and every link looks up its count.

Two vocabularies of n and m tokens can have n x m pairs, so steps 4 and 5 take
the shards in rounds of at most ``PAIRS`` pairs (one round for up to four
million); what a round broadcasts is bounded by that and the counts of all
rounds add up by row.  Nothing is moved but distinct pairs and vectors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import Merger
from loomgraph.llm.common import keep, slices
from loomgraph.llm.minimal_hash import PairHash, build
from loomgraph.llm.pieces import PieceEncoder
from loomgraph.llm.textcodes import mix

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
# Distinct pairs whose hash, keys and counts are broadcast at once (about 17 bytes each).
PAIRS = 1 << 22
# Pairs a shard of the hash holds on average.
SHARD_PAIRS = 1 << 14
# Bytes of text, and of packed ids, that a task works on at once.
TEXT_BYTES, ID_BYTES = 1 << 20, 1 << 19
# Vectors that one task of the tree adds up.
FAN = 16
# Distinct pairs a task holds before it hands them on.
HELD = 1 << 20


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(length: np.ndarray) -> np.dtype:
    """Little-endian unsigned integers that hold every id of a vocabulary."""
    return np.dtype("<u2" if len(length) <= 1 << 16 else "<u4")


class _Vocabulary:
    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.length = np.array([len(t) for t in tokens], np.int64)

    def joined(self, ids: np.ndarray) -> memoryview:
        """The bytes of all tokens in order."""
        if not len(ids):
            return memoryview(b"")
        data = pc.take(self.tokens, pa.array(ids)).buffers()[2]
        return memoryview(data).cast("B")[: int(self.length[ids].sum())]


@lru_cache(maxsize=2)
def byte_vocabulary(content: bytes):
    """Merges of the byte-level BPE model in ``content``, and its tokens' bytes by id.

    Special tokens are never made: their strings in a text are plain text.
    Any other normalizer, splitter or model than plain byte-level BPE is an error.
    """
    whole = json.loads(content)
    model, split = whole["model"], whole["pre_tokenizer"]
    plain = model["type"] == "BPE" and not model.get("ignore_merges") and not whole["normalizer"]
    if not plain or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE tokenizer")
    byte, vocabulary = _byte_of_char(), model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = {(vocabulary[a] << 32) | vocabulary[b]: rank for rank, (a, b) in reversed(list(enumerate(merges)))}
    merger = Merger([vocabulary[c] for _, c in sorted((b, c) for c, b in byte.items())], order, [vocabulary[a + b] for a, b in merges], {})
    added = {t["id"]: t["content"].encode() for t in whole["added_tokens"]}
    tokens = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if i not in added} | added
    return merger, _Vocabulary([tokens.get(i, b"") for i in range(max(tokens) + 1)])


@lru_cache(maxsize=2)
def piece_vocabulary(content: bytes):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, _Vocabulary(out)


def tokens(docs: DataFrame, text: str, id: str, byte_model: str, piece_model: str) -> DataFrame:
    """(id, a, b): both id rows, packed as ``_kind`` says; none where a text is null, empty or not reproduced."""
    shared = docs.sparkSession.sparkContext.broadcast((_content(byte_model), _content(piece_model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_model, a_words = byte_vocabulary(shared.value[0])
        b_model, b_words = piece_vocabulary(shared.value[1])
        encoder = PieceEncoder(a_model)
        kinds = [_kind(w.length) for w in (a_words, b_words)]
        for batch in slices(batches, 1, TEXT_BYTES):
            raw = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            texts = [t.decode("utf-8", "replace") for t in raw]
            a_ids = [np.frombuffer(ids, "<u4") for ids in encoder.encode([" " + t if t else "" for t in texts])]
            b_ids = [np.array(ids, "<u4") for ids in b_model.encode(texts, num_threads=1)]
            columns = ([], [])
            for whole, a, b in zip(raw, a_ids, b_ids):
                good = bool(whole) and a_words.joined(a) == b" " + whole and b_words.joined(b) == b" " + whole
                for column, ids, kind in zip(columns, (a, b), kinds):
                    column.append(ids.astype(kind).tobytes() if good else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], ["id", "a", "b"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a binary, b binary")


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed rows, and how many each row has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view(kind).astype(np.int64), (np.diff(at) // kind.itemsize).astype(np.int64)


class Aligned:
    """The tokens of some rows laid over their bytes.

    ``a_at`` and ``b_at`` are the places of the tokens that end links, ``row``
    the links' rows, ``keys`` their id pairs.
    """

    def __init__(self, a_column: pa.Array, b_column: pa.Array, a_length: np.ndarray, b_length: np.ndarray):
        self.a, self.n_a = _unpacked(a_column, _kind(a_length))
        self.b, self.n_b = _unpacked(b_column, _kind(b_length))
        a_end, b_end = np.cumsum(a_length[self.a]), np.cumsum(b_length[self.b])
        total = int(a_end[-1]) if len(a_end) else 0
        marks = np.zeros((2, total + 1), bool)
        marks[0, a_end], marks[1, b_end] = True, True
        joint = marks[0] & marks[1]
        self.a_at, self.b_at = np.flatnonzero(joint[a_end]), np.flatnonzero(joint[b_end])
        self.row = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.a_at]
        self.keys = (self.a[self.a_at] << 32) | self.b[self.b_at]
        self.links = np.bincount(self.row, minlength=len(self.n_a))

    def group_texts(self, a_words: pa.Array, b_words: pa.Array) -> list[bytes]:
        """Per row ``a1,a2|b1;a3|b2,b3``.  The word arrays hold every id followed by its two possible marks."""
        n_a = np.diff(self.a_at, prepend=-1)
        n_b = np.diff(self.b_at, prepend=-1)
        before_a, before_b = np.cumsum(n_b) - n_b, np.cumsum(n_a)
        a_last, b_last = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_last[self.a_at], b_last[self.b_at] = 1, 1
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.repeat(before_a, n_a)] = 2 * self.a + a_last
        code[np.arange(len(self.b)) + np.repeat(before_b, n_b)] = len(a_words) + 2 * self.b + b_last
        if not len(code):
            return [b""] * len(self.n_a)
        taken = pc.take(pa.concat_arrays([a_words, b_words]), pa.array(code))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(code) + 1)[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        data = memoryview(taken.buffers()[2])
        return [bytes(data[x : max(x, y - 1)]) for x, y in zip(at[:-1], at[1:])]


def _marked(n: int, inner: str, last: str) -> pa.Array:
    return pa.array([f"{i}{mark}".encode() for i in range(n) for mark in (inner, last)], pa.large_binary())


def linked_pairs(ids: DataFrame, a_length, b_length) -> DataFrame:
    """Distinct (h, key): linked id pairs and their scrambled values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)

        def rows(keys: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(mix(keys.astype(np.uint64)).view(np.int64)), pa.array(keys)], ["h", "key"])

        for batch in slices(batches, 1, ID_BYTES):
            new = Aligned(batch.column(1), batch.column(2), a_length.value, b_length.value).keys
            held = np.union1d(held, new)
            if len(held) > HELD:
                yield rows(held)
                held = held[:0]
        yield rows(held)

    return ids.mapInArrow(run, "h bigint, key bigint").dropDuplicates(["h", "key"])


def hash_shards(pairs: DataFrame, bits: int) -> DataFrame:
    """(shard, n, sizes, words, keys) of every shard's function; arrays are packed."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        parts = build(np.sort(keys))
        return pa.table(
            {"shard": [key[0].as_py()], "n": [len(keys)], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("sizes", "words", "keys"), parts)}}
        )

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    return pairs.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "shard bigint, n bigint, sizes binary, words binary, keys binary")


def _function(rows: list, bits: int) -> PairHash:
    shards = [(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["words"], np.uint64)) for r in rows]
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    return _Sparse([r["shard"] for r in rows], shards, bits, keys)


class _Sparse(PairHash):
    """Shards in ascending order; numbers without any pair have empty levels."""

    def __init__(self, numbers: list[int], shards: list, bits: int, keys: list):
        first = numbers[0] if numbers else 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        dense = [none] * (numbers[-1] - first + 1 if numbers else 0)
        for number, shard in zip(numbers, shards):
            dense[number - first] = shard
        super().__init__(dense, first, bits, keys)


def count_vectors(ids: DataFrame, function, sizes: list[tuple[int, int]], a_length, b_length) -> DataFrame:
    """(shard, counts): the dense vectors of all tasks, added up as a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = function.value
        dense = np.zeros(sum(n for _, n in sizes), np.int64)
        for batch in slices(batches, 1, ID_BYTES):
            place = table.places(Aligned(batch.column(1), batch.column(2), a_length.value, b_length.value).keys)
            spot, often = np.unique(place[place >= 0], return_counts=True)
            dense[spot] += often
        part, at = TaskContext.get().partitionId(), 0
        for shard, n in sizes:
            vector = dense[at : at + n]
            at += n
            if vector.any():
                yield pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "counts": pa.array([vector.tobytes()], pa.binary())})

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = 0
        for value in group.column("counts"):
            total = total + np.frombuffer(value.as_buffer(), np.int64)
        return pa.table({"shard": [key[0].as_py()], "part": [key[1].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "shard bigint, part bigint, counts binary"
    out, parts = ids.mapInArrow(run, schema), ids.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        out = out.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("shard", "part").applyInArrow(add, schema)
    return out.select("shard", "counts")


def best_counts(shards: DataFrame, counts: DataFrame) -> DataFrame:
    """(b, count): every piece id's highest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, vector in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                b = np.frombuffer(keys, np.int64) & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.frombuffer(vector, np.int64))], ["b", "count"])

    both = shards.select("shard", "keys").join(counts, "shard").select("keys", "counts")
    return both.mapInArrow(run, "b bigint, count bigint").groupBy("b").agg(F.max("count").alias("count"))


def _looked_up(ids: DataFrame, function, counts, best, a_length, b_length) -> DataFrame:
    """Per row: sizes, the digest of its groups, links with the highest count of their piece, and the counts' sum, over the function's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_words, b_words = _marked(len(a_length.value), ",", "|"), _marked(len(b_length.value), ",", ";")
        for batch in slices(batches, 1, ID_BYTES):
            laid = Aligned(batch.column(1), batch.column(2), a_length.value, b_length.value)
            place = function.value.places(laid.keys)
            known = place >= 0
            row, b = laid.row[known], (laid.keys[known] & 0xFFFFFFFF)
            count = counts.value[place[known]]
            n = len(laid.n_a)
            total = np.zeros(n, np.int64)
            np.add.at(total, row, count)
            hits = np.bincount(row[count == best.value[b]], minlength=n)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in laid.group_texts(a_words, b_words)]
            columns = [laid.n_a, laid.n_b, laid.links, laid.links, hits, total]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(digests), batch.column(3)], _NAMES)

    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in _NAMES[1:7]) + ", groups_sha256 string, row bigint")


_NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "row"]


def align_report(
    docs: DataFrame, text: str = "text", id: str = "doc_id", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, pairs_at_once: int = PAIRS
) -> DataFrame:
    """Per row (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A null or empty text, or one that either vocabulary does not give back byte
    by byte, has zeros and ''.  Repeated rows count each; a null id is kept;
    further columns are left out.  Every token holds a byte at least, so a
    group has one link.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    a_length = sc.broadcast(byte_vocabulary(_content(byte_model))[1].length)
    b_length = sc.broadcast(piece_vocabulary(_content(piece_model))[1].length)
    ids = keep(tokens(docs, text, id, byte_model, piece_model).withColumn("row", F.monotonically_increasing_id()))
    pairs = keep(linked_pairs(ids, a_length, b_length))
    n_pairs = pairs.count()
    bits = max(0, (n_pairs // SHARD_PAIRS).bit_length())
    shards = keep(hash_shards(pairs, bits))
    rounds, size = [[]], 0
    for r in shards.select("shard", "n").orderBy("shard").collect():  # one short row for 16 thousand pairs
        if rounds[-1] and size + r["n"] > pairs_at_once:
            rounds.append([])
            size = 0
        rounds[-1].append((r["shard"], r["n"]))
        size += r["n"]

    def between(part: list) -> F.Column:
        return F.col("shard").between(part[0][0], part[-1][0]) if part else F.lit(False)

    functions, counted = [], None
    for part in rounds:
        function = sc.broadcast(_function(shards.where(between(part)).orderBy("shard").collect(), bits))
        functions.append(function)
        vectors = keep(count_vectors(ids, function, part, a_length, b_length))
        counted = vectors if counted is None else counted.unionByName(vectors)
    best_of = np.zeros(len(b_length.value), np.int64)
    for r in best_counts(shards, counted).collect():  # a row per piece of the vocabulary at most
        best_of[r["b"]] = r["count"]
    best = sc.broadcast(best_of)
    found = []
    for part, function in zip(rounds, functions):
        rows = counted.where(between(part)).orderBy("shard").collect()
        dense = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        found.append(_looked_up(ids, function, sc.broadcast(dense), best, a_length, b_length))
    if len(found) == 1:
        return found[0].drop("row").withColumnRenamed("id", id)
    out = keep(found[0])
    for more in found[1:]:
        out = out.unionByName(keep(more))
    same = [F.first(c).alias(c) for c in _NAMES if c not in ("row", "n_best", "count_sum")]
    out = out.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(*_NAMES[:-1]).withColumnRenamed("id", id)
