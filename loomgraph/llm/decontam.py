"""Benchmark decontamination by greedy string tiling.

Words of documents and test items are folded and hashed; every run of ``MATCH``
words of a test item is a seed.  Documents' rolling (Karp-Rabin) window hashes
are joined with the seeds, the hits of one document and item are merged into
maximal matches, and the longest match that is still unmarked is marked again
and again, in document and item, until none of ``MATCH`` words is left.  An item
whose words are covered to ``COVERAGE`` by tiles, in whatever order they stand,
has leaked.

A test set is taken in parts of at most ``SEEDS`` seeds on average; a part's
sorted seeds are what every task gets, and documents never move.

Defined cases: null and empty texts have no words and never match; items
without words are skipped; an item shorter than ``MATCH`` words is one seed;
repeated items and repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textcodes import Block, blocks, windows

MATCH, COVERAGE = 5, 0.5
SEEDS = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True

_LEAK = "doc_id bigint, item_id bigint, n_tiles int, covered int, item_words int, coverage double"


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all words: runs of letters, digits and bytes beyond ASCII, A-Z folded."""
    begin, end, text = block.pieces(_WORD[block.data])
    return text, block.hashes(begin, end)


class Seeds:
    """The sorted seeds of some test items."""

    def __init__(self, items: list[tuple[int, str | None]], match: int = MATCH):
        self.match = match
        self.ids = np.array([i for i, _ in items], np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        self.size = np.zeros(len(items), np.int64)
        for b in blocks(pa.array([t for _, t in items], pa.string())):
            text, h = tokens(b)
            n = np.bincount(text, minlength=len(b))
            self.size[b.first : b.first + len(b)] = n
            start = np.cumsum(n) - n
            for width in range(1, match + 1):
                at, g = windows(h, text, width)
                take = n[text[at]] == width if width < match else np.ones(len(at), bool)
                at, g = at[take], g[take]
                parts.append((g, text[at] + b.first, at - start[text[at]], np.full(len(at), width)))
        g, item, pos, width = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
        order = np.argsort(g, kind="stable")
        self.hash, self.item, self.pos, self.width = g[order].astype(np.uint64), item[order], pos[order], width[order]
        self.widths = np.unique(self.width).tolist()

    def hits(self, text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the word, item, place in the item) of all shared seeds."""
        found = []
        for width in self.widths:
            at, g = windows(h, text, width)
            low = np.searchsorted(self.hash, g, "left")
            may = low < len(self.hash)
            may[may] = self.hash[low[may]] == g[may]
            at, g, low = at[may], g[may], low[may]
            many = np.searchsorted(self.hash, g, "right") - low
            seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at = np.repeat(at, many)
            right = self.width[seed] == width
            found.append((text[at[right]], at[right], self.item[seed[right]], self.pos[seed[right]]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def tiles(place: np.ndarray, pos: np.ndarray, words: int, match: int) -> tuple[int, int]:
    """Number of tiles and covered words of an item of ``words`` words, from the seeds shared with one text."""
    match = min(match, words)
    order = np.lexsort((place, place - pos))
    place, pos = place[order], pos[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(pos) != 1)])
    size = np.diff(np.r_[cut, len(place)]) + match - 1
    heap = [(-int(n), int(pos[c]), int(place[c])) for c, n in zip(cut, size, strict=True)]
    heapq.heapify(heap)
    low = int(place.min())
    in_text, in_item = np.zeros(int(place.max()) - low + match, bool), np.zeros(words, bool)
    n_tiles = 0
    while heap and not in_item.all():
        length, p, q = heapq.heappop(heap)
        length = -length
        free = ~(in_item[p : p + length] | in_text[q - low : q - low + length])
        if free.all():
            in_item[p : p + length] = True
            in_text[q - low : q - low + length] = True
            n_tiles += 1
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= match:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return n_tiles, int(in_item.sum())


def leaks_in(block: Block, seeds: Seeds, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, tiles, covered words, words) of the items that leaked into the texts of a block."""
    text, h = tokens(block)
    doc, place, item, pos = seeds.hits(text, h)
    if not len(doc):
        return []
    order = np.lexsort((pos, item, doc))
    doc, place, item, pos = doc[order], place[order], item[order], pos[order]
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    out = []
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(doc)], strict=True):
        words = int(seeds.size[item[a]])
        width = min(seeds.match, words)
        step = np.diff(np.r_[pos[a:b], pos[b - 1] + width])
        if np.minimum(step, width).sum() < coverage * words:  # all shared seeds together cover too little
            continue
        n, covered = tiles(place[a:b], pos[a:b], words, seeds.match)
        if covered >= coverage * words:
            out.append((int(doc[a]), int(item[a]), n, covered, words))
    return out


def seed_parts(benchmark: DataFrame, item_id: str, text: str, match: int = MATCH) -> Iterator[Seeds]:
    """The test set in parts of bounded size."""
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-n_bytes // (2 * SEEDS)))  # a word takes two bytes at least
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()
        yield Seeds([(r["id"], r["text"]) for r in mine], match)


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and leaked test item; clean documents have none."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for seeds in seed_parts(benchmark, "item_id", "text", match):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = shared.value
            for batch in batches:
                for b in blocks(batch.column(1)):
                    found = leaks_in(b, mine, coverage)
                    if found:
                        t, i, n, c, w = (np.array(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(t + b.first)), pa.array(mine.ids[i]), pa.array(n, pa.int32()), pa.array(c, pa.int32()), pa.array(w, pa.int32()), pa.array(c / w)],
                            ["doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage"],
                        )

        part = rows.mapInArrow(run, _LEAK)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows into which a test item leaked; all columns stay."""
    names = docs.columns
    for seeds in seed_parts(benchmark, "item_id", "text", match):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for b in blocks(batch.column(names.index("text"))):
                    for t, *_ in leaks_in(b, shared.value, coverage):
                        good[b.first + t] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
