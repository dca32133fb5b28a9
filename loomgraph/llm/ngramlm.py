"""Scoring texts with a smoothed n-gram model in sharded Elias-Fano tries.

A text is its words and one end.  The model's levels are single words, pairs and
triples (``order`` 3, or 2 without them):

    P(w | u v) = c(u v w) / (c(u v) + MASS)             if the triple was seen,
                 MASS / (c(u v) + MASS) * P(w | v)      otherwise,
    P(w | v)   = c(v w) / (c(v) + MASS)                 if the pair was seen,
                 MASS / (c(v) + MASS) * P(w)            otherwise,
    P(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1)).

The first word of a text has one word of context, its start.

Every token goes with its two words of context, packed, to the shard of the word
before it, once: the shard counts the training part, builds its trie (weights in
256 quantised levels each), and scores all tokens that came.  A word is
the context of as many tokens as it has occurrences, so a shard also knows its
words' exact counts.  All triples over a pair lie in the pair's shard, but not the
count of their context (u v).  Both cases of P(w | u v) divide by c(u v) + MASS,
though, so a triple keeps c(u v w) / MASS, and the back-off weight of (u v) is
added where the pair (u v) itself was counted.  No count crosses shards a second
time; words of unseen pairs meet the words' counts in one join.

Words, pairs and triples frequent enough to fill a shard are found by bounded
summaries, counted exactly in one more pass, and dealt over all shards.

Defined cases: a null or empty text is one end; without training rows the model
is the formula with N = V = 0; rows without an id train and are scored; repeated
rows are scored each; an empty table gives no row; other columns are ignored.
``doc_id`` is read as a 64-bit number.  Word ids are 48 bits of a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import held_out, keep
from loomgraph.llm.eliasfano import Trie
from loomgraph.llm.textcodes import blocks, mix, sums

MASS = 2.0
ORDER = 3
#: Tokens of a shard on average, tokens packed at once, documents packed at once.
SHARD, PACK, PACK_DOCS = 800_000, 1_200_000, 1 << 14
#: Words, pairs and triples (each) that are dealt over all shards, at most.
HOT = 1 << 14
TASK_SUMMARY = 1 << 12
START, END = np.uint64(0), np.uint64(1)


def word_ids(h: np.ndarray) -> np.ndarray:
    return np.maximum(h >> np.uint64(16), np.uint64(2))


def tokens_of(ids: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word before the context, context, word, text) of every token, the end of each text included; before the first two words stands the start."""
    size = np.bincount(owner, minlength=n_texts) + 1
    last = np.cumsum(size) - 1
    first = last - size + 1
    past, context, word = (np.empty(len(ids) + n_texts, np.uint64) for _ in range(3))
    at = np.arange(len(ids)) + owner
    word[at], context[at + 1] = ids, ids
    word[last], context[first] = END, START
    past[1:] = context[:-1]
    past[first] = START
    return past, context, word, np.repeat(np.arange(n_texts), size)


def _squeeze(x: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of their places, compressed: most are small, so their high bytes are alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_rising(x: np.ndarray) -> bytes:
    """48-bit ids in runs that rise: their differences, whose high bytes are mostly 0."""
    step = np.diff(x, prepend=np.uint64(0)) & np.uint64((1 << 48) - 1)
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack_rising(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(6, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :6] = planes.T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) & np.uint64((1 << 48) - 1)


def _pair_id(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(word))


def _triple_id(past: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return mix(pair + mix(past + np.uint64(1)))


def _top(parts: list[tuple[np.ndarray, ...]], top: int) -> tuple[np.ndarray, ...]:
    """The most frequent keys of (key, shorter key, n) parts, added up."""
    key, up, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(key)
    key, up, n = key[order], up[order], n[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, start) if len(key) else n
    key, up = key[start], up[start]
    if len(key) > top:
        most = np.argpartition(-n, top)[:top]
        key, up, n = key[most], up[most], n[most]
    return key, up, n


class Hot:
    """Frequent words, pairs and triples (sorted keys) with their exact training counts."""

    def __init__(self, *keys: np.ndarray):
        self.keys = keys
        self.n = [np.zeros(len(k), np.int64) for k in keys]

    def at(self, kind: int, x: np.ndarray) -> np.ndarray:
        table = self.keys[kind]
        if not len(table):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return np.where(table[at] == x, at, -1)

    def levels(self, past: np.ndarray, context: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, places among the tokens, places among the keys) of frequent ones; a longer one is asked for only where the shorter one is."""
        hit = self.at(0, context)
        where = np.flatnonzero(hit >= 0)
        yield 0, where, hit[where]
        for kind in range(1, len(self.keys)):
            key = _pair_id(context[where], word[where])
            hit = self.at(kind, key if kind == 1 else _triple_id(past[where], key))
            where, hit = where[hit >= 0], hit[hit >= 0]
            yield kind, where, hit


def frequent(rows: DataFrame, least: int, order: int) -> tuple[Hot, int]:
    """Words, pairs and triples that occur about ``least`` times or more, and the number of tokens of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, {kind: [] for kind in range(order)}
        for batch in batches:
            for b in blocks(batch.column(0)):
                begin, end, owner = b.words()
                p, c, w, _ = tokens_of(word_ids(b.hashes(begin, end)), owner, len(b))
                total += len(c)
                key, up = c, np.zeros(len(c), np.uint64)
                for kind in range(order):
                    if kind:  # what occurs once is not frequent, nor is anything longer over it
                        key, up = (_pair_id(c, w), key) if kind == 1 else (_triple_id(p, key), key)
                    some, at, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    often = n > 1
                    held[kind].append((some[often], up[at[often]], n[often]))
                    if len(held[kind]) >= 16:
                        held[kind] = [_top(held[kind], 16 * TASK_SUMMARY)]
                    stay = often[inverse]
                    p, c, w, key = p[stay], c[stay], w[stay], key[stay]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([-1], [0], [0], [total])], ["kind", "k", "up", "n"])
        for kind, parts in held.items():
            if parts:
                key, up, n = _top(parts, TASK_SUMMARY)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key.view(np.int64)), pa.array(up.view(np.int64)), pa.array(n)], ["kind", "k", "up", "n"])

    found = rows.select("text").mapInArrow(run, "kind bigint, k bigint, up bigint, n bigint").groupBy("kind", "k", "up").agg(F.sum("n").alias("n"))
    found = keep(found.where((F.col("kind") == -1) | (F.col("n") >= least)))
    total = found.where("kind = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys: list[np.ndarray] = []
    for kind in range(order):
        got = np.array([(r["k"], r["up"]) for r in found.where(F.col("kind") == kind).orderBy(F.desc("n"), "k").limit(HOT).collect()], np.int64).reshape(-1, 2).view(np.uint64)
        some = got[np.isin(got[:, 1], keys[-1]), 0] if keys else np.append(got[:, 0], START)  # the start of a text is a context of every row
        keys.append(np.unique(some))
    return Hot(*keys), int(total)


def count_hot(rows: DataFrame, hot: Hot) -> Hot:
    """Exact training counts of the frequent words, pairs and triples, summed in the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        counts = [np.zeros(len(k), np.int64) for k in mine.keys]
        for batch in batches:
            for b in blocks(batch.column(0)):
                begin, end, owner = b.words()
                p, c, w, _ = tokens_of(word_ids(b.hashes(begin, end)), owner, len(b))
                for kind, _, hit in mine.levels(p, c, w):
                    counts[kind] += np.bincount(hit, minlength=len(counts[kind]))
        n = np.concatenate(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["i", "n"])

    got = rows.where("train").select("text").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(sum(map(len, hot.keys)), np.int64)
    for r in got:
        n[r["i"]] = r["n"]
    hot.n = np.split(n, np.cumsum([len(k) for k in hot.keys])[:-1])
    return hot


_PACKED = "shard int, ref bigint, train binary, context binary, runs binary, doc binary, vocab binary, word binary, past binary, ids binary, known_id binary"


def _packed(rows: DataFrame, hot: Hot, shards: int) -> DataFrame:
    """Packed tokens by shard; negative shards carry the documents' ids and lengths."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def pack(ids: list[np.ndarray], owner: list[np.ndarray], doc_id: list, train: list, ref: int) -> Iterator[pa.RecordBatch]:
        n_docs = len(doc_id)
        past, context, word, doc = tokens_of(np.concatenate(ids), np.concatenate(owner), n_docs)
        size = np.bincount(doc, minlength=n_docs).astype(np.uint32)
        mine = shared.value
        spread = context.copy()
        for kind, where, _ in mine.levels(past, context, word):
            deal = word[where] if kind == 0 else past[where] if kind < len(mine.keys) - 1 else doc[where].astype(np.uint64) + np.uint64(ref)
            spread[where] += mix(deal + np.uint64(kind))
        shard = (mix(spread) % np.uint64(shards)).astype(np.int32)
        del spread
        order = np.lexsort((context, shard))
        shard, past, context, word, doc = shard[order], past[order], context[order], word[order], doc[order]
        edge = np.searchsorted(shard, np.arange(shards + 1))
        flags = np.packbits(np.array(train, bool)).tobytes()
        out: dict[str, list] = {k: [] for k in ("shard", "ref", "train", "context", "runs", "doc", "vocab", "word", "past", "ids", "known_id")}

        def add(**row) -> None:
            for k, held in out.items():
                held.append(row.get(k))

        for s in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[s], edge[s + 1]
            start = np.flatnonzero(np.r_[True, context[a + 1 : b] != context[a : b - 1]])
            both = word[a:b] if len(mine.keys) < 3 else np.concatenate([word[a:b], past[a:b]])
            vocab, index, times = np.unique(both, return_inverse=True, return_counts=True)
            place = np.argsort(-np.frexp(times)[1].astype(np.int8), kind="stable")  # frequent words get small numbers; ids rise among words about as frequent
            number = np.empty(len(vocab), np.uint16 if len(vocab) <= 1 << 16 else np.uint32)
            number[place] = np.arange(len(vocab))
            vocab, index = vocab[place], number[index]
            add(
                shard=s,
                ref=ref,
                train=flags,
                context=_pack_rising(context[a:b][start]),
                runs=_squeeze(np.diff(np.r_[start, b - a]).astype(np.uint32)),
                doc=_squeeze(doc[a:b].astype(np.uint16)),
                vocab=_pack_rising(vocab),
                word=_squeeze(index[: b - a]),
                past=_squeeze(index[b - a :]),
            )
        known = np.array([x is not None for x in doc_id])
        add(
            shard=-1 - int(mix(np.array([ref], np.uint64))[0] % np.uint64(shards)),
            ref=ref,
            train=flags,
            runs=size.tobytes(),
            ids=np.array([x or 0 for x in doc_id], np.int64).tobytes(),
            known_id=np.packbits(known).tobytes(),
        )
        kinds = {"shard": pa.int32(), "ref": pa.int64()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        turn, ids, owner, doc_id, train, size = 0, [], [], [], [], 0
        for batch in batches:
            every, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for b in blocks(batch.column(1)):
                if doc_id and (size >= PACK or len(doc_id) + len(b) > PACK_DOCS):
                    yield from pack(ids, owner, doc_id, train, (part << 34) | (turn << 14))
                    turn, ids, owner, doc_id, train, size = turn + 1, [], [], [], [], 0
                begin, end, text = b.words()
                h = word_ids(b.hashes(begin, end))
                for a in range(0, len(b), PACK_DOCS):  # a block of very many short texts
                    if a:
                        yield from pack(ids, owner, doc_id, train, (part << 34) | (turn << 14))
                        turn, ids, owner, doc_id, train, size = turn + 1, [], [], [], [], 0
                    stop = min(len(b), a + PACK_DOCS)
                    lo, hi = np.searchsorted(text, [a, stop])
                    ids.append(h[lo:hi])
                    owner.append(text[lo:hi] - a + len(doc_id))
                    doc_id += every[b.first + a : b.first + stop]
                    train += flags[b.first + a : b.first + stop]
                    size += hi - lo
        if doc_id:
            yield from pack(ids, owner, doc_id, train, (part << 34) | (turn << 14))

    return rows.select("doc_id", "text", "train").mapInArrow(run, _PACKED)


# kind 0: what a shard adds to the documents of a pack; 1: a word's training count; 2: words after unseen pairs; 3: the documents of a pack
_PARTS = "kind int, ref bigint, w bigint, n bigint, train binary, doc binary, base binary, score binary, known binary, unseen binary, runs binary, ids binary, known_id binary"
_BINARY = ("train", "doc", "base", "score", "known", "unseen", "runs", "ids", "known_id")
_WHOLE = {"ref": pa.int64(), "w": pa.int64(), "n": pa.int64()} | {k: pa.binary() for k in _BINARY}


def _rows(kind: int, size: int, **given) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(size, kind, np.int32)), **{k: pa.array(given[k], t) if k in given else pa.nulls(size, t) for k, t in _WHOLE.items()}})


def _small(x: np.ndarray) -> bytes:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint32)


class Tokens:
    """The tokens of one shard: ids in ``vocab``, the rest as numbers in it; ``text`` is a place in ``texts``, which are (number of the pack << 14) | document, in order."""

    def __init__(self, t: pa.Table, order: int):
        rows = [{k: t[k][i].as_py() for k in ("ref", "train", "context", "runs", "doc", "vocab", "word", "past")} for i in range(t.num_rows)]
        held = [_unpack_rising(r[k]) for r in rows for k in ("vocab", "context")]
        self.vocab = np.unique(np.concatenate([*held, [START]]))
        self.ref = np.array([r["ref"] for r in rows], np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        texts, n_texts = [], 0
        for i, r in enumerate(rows):
            doc = _unsqueeze(r["doc"], np.uint16)
            own, contexts = (np.searchsorted(self.vocab, x).astype(np.uint32) for x in held[2 * i : 2 * i + 2])
            kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
            flags = np.unpackbits(np.frombuffer(r["train"], np.uint8)).astype(bool)
            parts[0].append(np.repeat(contexts, _unsqueeze(r["runs"], np.uint32)))
            parts[1].append(own[_unsqueeze(r["word"], kind)])
            parts[2].append(own[_unsqueeze(r["past"], kind)] if order > 2 else np.zeros(len(doc), np.uint32))
            some, at = np.unique(doc, return_inverse=True)
            parts[3].append(n_texts + at)
            texts.append((i << 14) + some.astype(np.int64))
            n_texts += len(some)
            parts[4].append(flags[doc])
        context, word, past, text, train = (np.concatenate(p) for p in parts)
        self.texts = np.concatenate(texts)
        del parts, rows, held, texts
        if len(self.vocab) <= 1 << 21:  # three numbers fit one key
            at = np.argsort(((context.astype(np.uint64) << np.uint64(42)) | (word.astype(np.uint64) << np.uint64(21))) | past)
        else:
            at = np.lexsort((past, (context.astype(np.uint64) << np.uint64(32)) | word))
        self.context, self.word, self.past, self.text, self.train = context[at], word[at], past[at], text[at], train[at]


def _new(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def score_shard(t: Tokens, hot: Hot, mass: float = MASS, order: int = ORDER) -> list[pa.Table]:
    """Counts, trie and scores of all tokens of one shard."""
    new_context, new_pair = _new(t.context), _new(t.context, t.word)
    row_at, pair_at = (np.cumsum(x, dtype=np.int32) - 1 for x in (new_context, new_pair))
    c_context = t.vocab[t.context[new_context]]
    u_word, u_row = t.vocab[t.word[new_pair]], row_at[new_pair]
    u_context = c_context[u_row]
    n_pair = np.bincount(pair_at, weights=t.train, minlength=len(u_word)).astype(np.int64)
    n_context = np.bincount(row_at, weights=t.train, minlength=len(c_context)).astype(np.int64)
    often = hot.at(0, c_context)
    n_context[often >= 0] = hot.n[0][often[often >= 0]]
    for kind, where, hit in hot.levels(u_context, u_context, u_word):
        if kind == 1:
            n_pair[where] = hot.n[1][hit]

    seen, have = n_pair > 0, n_context > 0
    rank, pair_rank = np.cumsum(have) - 1, np.cumsum(seen) - 1
    deep = {}
    if order > 2:
        new_triple = _new(t.context, t.word, t.past)
        triple_at = np.cumsum(new_triple, dtype=np.int32) - 1
        t_past, t_pair = t.vocab[t.past[new_triple]], pair_at[new_triple]
        n_triple = np.bincount(triple_at, weights=t.train, minlength=len(t_past)).astype(np.int64)
        for kind, where, hit in hot.levels(t_past, u_context[t_pair], u_word[t_pair]):
            if kind == 2:
                n_triple[where] = hot.n[2][hit]
        two = u_context[t_pair] != START  # the first word of a text has one word of context
        keep_triple = (n_triple > 0) & two
        deep = {
            "pair_backoff": np.log10(mass / (n_pair[seen] + mass)),
            "pair": pair_rank[t_pair[keep_triple]],
            "past": t_past[keep_triple],
            "weight": np.log10(n_triple[keep_triple] / mass),
        }
    trie = Trie(
        c_context[have],
        n_context[have],
        rank[u_row[seen]],
        u_word[seen],
        np.log10(n_pair[seen] / (n_context[u_row[seen]] + mass)),
        np.log10(mass / (n_context[have] + mass)),
        **deep,
    )
    asked = trie.contexts(c_context)
    place = trie.pairs(asked[u_row], u_word)
    hit = place >= 0
    log_p = np.zeros(len(u_word))
    log_p[hit] = trie.value[trie.code[place[hit]]]
    back = ~hit & (asked[u_row] >= 0)
    log_p[back] = trie.back_value[trie.back[asked[u_row[back]]]]
    # frequent words after unseen pairs: their counts are known here
    known_word = hot.at(0, u_word)
    known_word[u_word == END] = hot.at(0, np.array([START]))[0]  # as many ends as starts
    direct = ~hit & (known_word >= 0)
    log_p[direct] += np.log10(hot.n[0][known_word[direct]] + 0.5)

    token = log_p[pair_at]
    if order > 2:
        found = trie.triples(asked[u_row[t_pair]], np.where(two, place[t_pair], -1), t_past)
        value = log_p[t_pair]
        value[found >= 0] = trie.deep_value[trie.deep_code[found[found >= 0]]]
        token = value[triple_at]
        # this pair is the context of the text's next word
        after = np.zeros(len(u_word))
        onward = hit & (u_word != END)
        after[onward] = trie.pair_back_value[trie.pair_back[place[onward]]]
        token += after[pair_at]

    count = np.zeros(len(c_context), np.int64)
    count[asked >= 0] = trie.count[asked[asked >= 0]]
    is_word = c_context != START
    base = np.where(is_word, np.log10(count + 0.5), 0.0)
    texts, text = t.texts, t.text
    n = len(texts)
    per = [
        sums(base[row_at], text, n),
        sums(token, text, n).astype(np.float32),
        np.bincount(text, weights=(is_word & (count > 0))[row_at], minlength=n).astype(np.int64),
        np.bincount(text, weights=~hit[pair_at], minlength=n).astype(np.int64),
    ]
    edge = np.searchsorted(texts, np.arange(len(t.ref) + 1) << 14)
    cuts = [slice(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    doc = (texts & ((1 << 14) - 1)).astype(np.uint16)
    out = [
        _rows(
            0,
            len(cuts),
            ref=t.ref,
            doc=[doc[c].tobytes() for c in cuts],
            base=[per[0][c].tobytes() for c in cuts],
            score=[per[1][c].tobytes() for c in cuts],
            known=[_small(per[2][c]) for c in cuts],
            unseen=[_small(per[3][c]) for c in cuts],
        )
    ]
    own = have & (often < 0)
    out.append(_rows(1, int(own.sum()), w=c_context[own].view(np.int64), n=n_context[own]))
    lost = np.flatnonzero((~hit & ~direct)[pair_at])
    at = t.texts[t.text[lost]]
    out.append(_rows(2, len(lost), ref=t.ref[at >> 14] + (at & ((1 << 14) - 1)).astype(np.int64), w=u_word[pair_at[lost]].view(np.int64)))
    return out


def _of_pack(t: pa.Table) -> pa.Table:
    """(ref, doc_id, train, tokens, known, unseen, base, score) of a pack's documents, added up over the shards."""
    rows = t.to_pylist()
    docs = next(r for r in rows if r["kind"] == 3)
    n = len(docs["ids"]) // 8
    got = {k: np.zeros(n) for k in ("known", "unseen", "base", "score")}
    for r in rows:
        if r["kind"] == 0:
            doc = np.frombuffer(r["doc"], np.uint16)  # every document once
            for k in ("known", "unseen"):
                got[k][doc] += _wide(r[k], len(doc))
            got["base"][doc] += np.frombuffer(r["base"], np.float64)
            got["score"][doc] += np.frombuffer(r["score"], np.float32)
    known_id, train = (np.unpackbits(np.frombuffer(docs[k], np.uint8))[:n].astype(bool) for k in ("known_id", "train"))
    return pa.table(
        {
            "ref": docs["ref"] + np.arange(n),
            "doc_id": pa.array(np.frombuffer(docs["ids"], np.int64), pa.int64(), mask=~known_id),
            "train": train,
            "tokens": np.frombuffer(docs["runs"], np.uint32).astype(np.int64),
            "known": got["known"].astype(np.int64),
            "unseen": got["unseen"].astype(np.int64),
            "base": got["base"],
            "score": got["score"],
        }
    )


def score_texts(docs: DataFrame, train: F.Column, shard: int = SHARD, order: int = ORDER) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row; ``docs`` is a stored table, ``order`` 2 or 3."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", train.alias("train"))
    hot, total = frequent(rows, max(2, shard // 8), order)
    hot = count_hot(rows, hot)
    shards = max(1, -(-total // shard))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            given = {k: t[k].to_pylist() for k in ("ref", "train", "runs", "ids", "known_id")}
            return _rows(3, t.num_rows, **given)
        return pa.concat_tables(score_shard(Tokens(t, order), shared.value, order=order))

    main = keep(_packed(rows, hot, shards).groupBy("shard").applyInArrow(run, _PARTS))
    counts = main.where("kind = 1").select("w", F.col("n").alias("c"))
    v, n = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = int(hot.n[0][0])  # the start of a text is the smallest word
    v += int((hot.n[0][1:] > 0).sum()) + (ends > 0)
    n += int(hot.n[0][1:].sum()) + ends
    whole = float(np.log10(n + 0.5 * (v + 1)))

    lost = main.where("kind = 2").groupBy("ref", "w").agg(F.count(F.lit(1)).alias("k")).join(counts, "w", "left")
    lost = lost.groupBy("ref").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("lost"))
    packs = main.where("kind = 0 or kind = 3").select("kind", "ref", *_BINARY)
    every = packs.groupBy("ref").applyInArrow(_of_pack, "ref bigint, doc_id bigint, train boolean, tokens bigint, known bigint, unseen bigint, base double, score double")
    return every.join(lost, "ref", "left").select(
        "doc_id",
        "train",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 0.5)) - F.col("tokens") * whole).alias("base_score"),
        (F.col("score") + F.coalesce("lost", F.lit(0.0)) - F.col("unseen") * whole).alias("score"),
    )


def lm_report(docs: DataFrame) -> DataFrame:
    out = held_out("doc_id", 5, 1)
    return score_texts(docs, ~out).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
