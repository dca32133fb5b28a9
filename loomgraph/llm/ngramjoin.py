"""Jaccard self-join of documents on word n-grams by rare-first prefix filtering.

A document's set is its distinct 5-word shingles (a shorter text is one shingle
of all its words).  Equal sets are one node, so exact copies are compared never.
Shingles are put into one global order, rare ones first, by a frequency summary
over the whole corpus; only a set's prefix in that order is indexed, since two
sets that link must share a shingle of both prefixes.  Length and positional
filters act on the shared shingle, a suffix filter on the sets' cells before the
one verification of a pair.

A set of g near copies would give g^2 pairs.  What is asked for are components,
so each shingle's documents first meet one pivot only, the document whose
shingles are most common among them; then exactly the candidate pairs whose
documents still lie in different components are verified.  No link between
different components is lost, and pairs inside one are never made.

Defined cases: null texts and texts without words have an empty set and link
with nothing; repeated rows link as copies; a null id never names a component
unless all of its ids are null; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keep
from loomgraph.llm.textcodes import Block, blocks, mix, sums, windows
from loomgraph.operators.components import components

WORDS = 5
#: Similarity in hundredths.
SIMILAR = 75
#: Entries of a task's frequency summary and of the merged one; a shingle left out counts as rare, which moves its place in the order and nothing else.
TASK_SUMMARY, SUMMARY = 1 << 16, 1 << 18
#: Documents of one shingle that meet one pivot in one task, on average.
HOT = 100_000
#: Prefix rows sorted in one task.
TASK_ROWS = 1 << 18
BLOCK = 1 << 18  # bytes of text taken at a time
#: Cells of a set at least; longer sets have a cell for about two members.
CELLS = 256
#: 64-bit words of the table that tells which sets are wanted (8 MB).
NAME_WORDS = 1 << 20


def shingles(block: Block, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, n of every text): the distinct shingles of each text, sorted by text and hash."""
    begin, end, text = block.words()
    h = block.hashes(begin, end)
    place, g = windows(h, text, size)
    owner = text[place]
    words = np.bincount(text, minlength=len(block))
    for few in range(1, size):  # texts of fewer words are one sequence
        at, whole = windows(h, text, few)
        short = words[text[at]] == few
        g, owner = np.concatenate([g, whole[short]]), np.concatenate([owner, text[at][short]])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return owner, g, np.bincount(owner, minlength=len(block))


def signatures(owner: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every set, as two signed numbers."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, owner, mix(g ^ np.uint64(salt)))
        out.append(mix(total + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, check, cells) for every row; node and check are null for an empty set.

    Cells are the set's counts in equal ranges of the hash, a byte each, or empty where one does not fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), BLOCK):
                owner, g, n = shingles(b)
                one, two = signatures(owner, g, n)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, len(b)), pa.array(n, pa.int64()), pa.array(one, mask=empty), pa.array(two, mask=empty), pa.array(_cells(g, n), pa.binary())],
                    ["doc_id", "n", "node", "check", "cells"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, node bigint, `check` bigint, cells binary")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], top: int) -> tuple[np.ndarray, np.ndarray]:
    g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g)
    g, n = g[order], n[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    g, n = g[start], np.add.reduceat(n, start) if len(g) else n
    often = n > 1
    g, n = g[often], n[often]
    if len(g) > top:
        most = np.argpartition(-n, top)[:top]
        g, n = g[most], n[most]
    return g, n


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles and their counts: bounded summaries of all tasks, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for b in blocks(batch.column(0), BLOCK):
                owner, g, n = shingles(b)
                node, _ = signatures(owner, g, n)
                fresh = np.zeros(len(b), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                g = g[fresh[owner]]
                held.append((g, np.ones(len(g), np.int64)))
                size += len(g)
                if size > 1 << 22:
                    held = [_merged(held, 4 * TASK_SUMMARY)]
                    size = len(held[0][0])
                if len(seen) > 1 << 20:
                    seen.clear()
        if held:
            g, n = _merged(held, TASK_SUMMARY)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    per = docs.select("text").mapInArrow(run, "g bigint, n bigint")
    top = per.groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(SUMMARY).toPandas()
    g, n = top["g"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(g)
    return g[order], n[order]


def _prefix_rows(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], similar: int) -> DataFrame:
    """(g, salt, node, n, pos, centre): the prefix of every set; centre is high where shingles are common."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = shared.value
        for batch in batches:
            for b in blocks(batch.column(0), BLOCK):
                owner, g, n = shingles(b)
                node, _ = signatures(owner, g, n)
                _, one = np.unique(node, return_index=True)
                mine = np.zeros(len(b), bool)
                mine[one] = True
                mine &= n > 0
                if len(often):
                    at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                    df = np.where(often[at] == g, count[at], 0)
                else:
                    df = np.zeros(len(g), np.int64)
                centre = 1000 * sums((df > 0).astype(float), owner, len(b)) / np.maximum(n, 1)
                order = np.lexsort((g, df, owner))
                g, df = g[order], df[order]
                first = np.cumsum(n) - n
                pos = np.arange(len(g)) - first[owner]
                prefix = n - (similar * n + 99) // 100 + 1
                take = (pos < prefix[owner]) & mine[owner]
                o, g, df, pos = owner[take], g[take], df[take], pos[take]
                salt = (mix(node[o].view(np.uint64)) % (df // HOT + 1).astype(np.uint64)).astype(np.int32)
                salt[df < HOT] = -1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.view(np.int64)),
                        pa.array(salt),
                        pa.array(node[o]),
                        pa.array(n[o].astype(np.int32)),
                        pa.array(pos.astype(np.int32)),
                        pa.array(centre[o].astype(np.int32)),
                    ],
                    ["g", "salt", "node", "n", "pos", "centre"],
                )

    return docs.select("text").mapInArrow(run, "g bigint, salt int, node bigint, n int, pos int, centre int")


def _with_pivots(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows of shingles that at least two nodes hold, each with its group's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        g, salt, node, n, pos, centre = (t.column(i).to_numpy() for i in range(6))
        del t
        order = np.lexsort((node, -centre, salt, g))
        del centre
        g, salt, node, n, pos = g[order], salt[order], node[order], n[order], pos[order]
        del order
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])  # copies met by other tasks
        g, salt, node, n, pos = g[new], salt[new], node[new], n[new], pos[new]
        start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])])
        size = np.diff(np.r_[start, len(g)])
        head = np.repeat(start, size)
        # a group of one stays when its shingle is split over salts: other salts may hold partners
        stay = (np.repeat(size, size) > 1) | (salt >= 0)
        whole = {"g": g, "node": node, "n": n, "pos": pos, "pivot": node[head], "pivot_n": n[head], "pivot_pos": pos[head]}
        for a in range(0, len(g), 1 << 17):
            part = stay[a : a + (1 << 17)]
            yield pa.RecordBatch.from_pydict({k: pa.array(v[a : a + (1 << 17)][part]) for k, v in whole.items()})

    dealt = rows.repartition(tasks, "g", "salt")
    return dealt.mapInArrow(run, "g bigint, node bigint, n int, pos int, pivot bigint, pivot_n int, pivot_pos int")


def _may_link(n: str, pos: str, m: str, at: str, similar: int) -> str:
    """Length and positional filter for sets of n and m shingles whose first shared one is at pos and at.

    A pair that links passes at its first shared shingle; later ones need not.
    """
    need = f"cast(ceil({similar} * ({n} + {m}) / {100 + similar}.0D - 1e-9) as int)"
    return f"100 * least({n}, {m}) >= {similar} * greatest({n}, {m}) and least({n} - {pos}, {m} - {at}) >= {need}"


def _name_bits(nodes: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds the names of ``nodes``; a text outside it cannot be one of them."""
    spots = "array(struct(node & {m} as w, shiftright(node, 20) & 63 as b), struct(shiftright(node, 26) & {m} as w, shiftright(node, 46) & 63 as b))".format(m=NAME_WORDS - 1)
    rows = nodes.select(F.explode(F.expr(spots)).alias("s")).groupBy("s.w").agg(F.bit_or(F.expr("shiftleft(1L, cast(s.b as int))")).alias("bits")).toPandas()
    out = np.zeros(NAME_WORDS, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _named_in(bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = node.view(np.uint64)
    out = np.ones(len(x), bool)
    for a, b in ((0, 20), (26, 46)):
        word = bits[((x >> np.uint64(a)) & np.uint64(NAME_WORDS - 1)).astype(np.int64)]
        out &= (word >> ((x >> np.uint64(b)) & np.uint64(63))) & np.uint64(1) == 1
    return out


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of the sets that ``nodes`` names, and of the few texts that its bit table lets through.

    Members are sorted 64-bit hashes.  Texts stay where they are; only wanted sets move.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_name_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0), BLOCK):
                owner, g, n = shingles(b)
                node, _ = signatures(owner, g, n)
                _, first = np.unique(node, return_index=True)
                first = first[_named_in(shared.value, node[first]) & (n[first] > 0)]
                end = np.cumsum(n)
                raw = [g[end[i] - n[i] : end[i]].tobytes() for i in first.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(raw, pa.binary())], ["node", "members"])

    return docs.select("text").mapInArrow(run, "node bigint, members binary").dropDuplicates(["node"])


def _cells(g: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The cells of each text; ``g`` holds the sorted hashes of text after text, ``n`` of each."""
    out = []
    end = np.cumsum(n)
    for e, k in zip(end.tolist(), n.tolist(), strict=True):
        width = max(CELLS.bit_length() - 1, (k // 2).bit_length())
        if not k:
            out.append(b"")
            continue
        count = np.bincount((g[e - k : e] >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width)
        out.append(count.astype(np.uint8).tobytes() if count.max() < 256 else b"")
    return out


def may_share(x: bytes, y: bytes, similar: int = SIMILAR) -> bool:
    """Suffix filter: sets share at most the sum of their cells' smaller counts, in the coarser one's cells."""
    if not x or not y:
        return True
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    cells = min(len(p), len(q))
    p, q = (v.reshape(cells, -1).sum(1, dtype=np.int64) for v in (p, q))
    return int(np.minimum(p, q).sum()) >= -(-similar * int(p.sum() + q.sum()) // (100 + similar))


def linked(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    """The exact test on two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= similar * (len(a) + len(b) - same)


def _suffix_filtered(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs that the suffix filter leaves."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cells = sets.select("node", "cells").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    one = cells.select(F.col("node").alias("a"), F.col("cells").alias("x"))
    two = cells.select(F.col("node").alias("b"), F.col("cells").alias("y"))
    full = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [may_share(x, y, similar) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return full.mapInArrow(run, "a bigint, b bigint")


def _verified(docs: DataFrame, candidates: DataFrame, table: DataFrame, similar: int) -> DataFrame:
    """The candidate pairs (a, b) that link; each is checked once, on the whole sets."""
    pairs = keep(_suffix_filtered(keep(candidates), table, similar))
    sets = keep(_sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    full = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similar) for x, y in zip(xs, ys, strict=True)]
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return full.mapInArrow(run, "a bigint, b bigint")


def join_documents(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    sets = keep(document_sets(docs))
    sizes = sets.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("n").alias("n")).where("node is not null")
    nodes = keep(sizes)
    clash, total = nodes.agg(F.count_if(F.expr("lo <> hi")), F.coalesce(F.sum("n"), F.lit(0))).first()
    if clash:
        raise ValueError("two different sets have one 64-bit name")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * (100 - similar) // 100 // TASK_ROWS))
    index = keep(_with_pivots(_prefix_rows(docs, frequent_shingles(docs), similar), tasks))
    star = index.where("node <> pivot").where(_may_link("n", "pos", "pivot_n", "pivot_pos", similar))
    near = keep(_verified(docs, star.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets, similar))
    near = near.unionByName(keep(_verified(docs, _across(index, near, similar), sets, similar)))
    grouped = components(near, "a", "b").select(F.col("node_id").alias("node"), "comp")
    return _named(sets, grouped)


def _across(index: DataFrame, links: DataFrame, similar: int) -> DataFrame:
    """Candidate pairs of nodes that share a prefix shingle and lie in different components so far.

    The shorter set of a pair that links has its first shared shingle in a still
    shorter prefix, so shorter sets are looked up by that one, and only among
    sets of like length.  Of one shingle's short rows, those of the commonest
    component meet rows of other components only.
    """
    comps = components(links, "a", "b").select(F.col("node_id").alias("node"), "comp")
    placed = index.join(comps, "node", "left").select("g", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"))
    short = F.expr(f"{100 + similar} * pos <= {100 - similar} * n")
    mixed = placed.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(short).alias("any")).where("lo <> hi and any").select("g")
    rest = keep(placed.join(mixed, "g", "left_semi"))
    # a little wider than the length filter, so that lengths that may link lie in one band or in neighbours
    band = F.floor(F.log("n") / float(np.log(101 / similar))).cast("int")
    low = rest.where(short).withColumn("band", band)
    main = low.groupBy("g", "band", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("g", "band").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    low = low.join(main, ["g", "band"]).withColumn("side", F.when(F.col("comp") == F.col("main"), 0).otherwise(1)).drop("main")
    high = rest.withColumn("band", F.explode(F.array(band, band - 1))).join(main, ["g", "band"])
    high = high.withColumn("side", F.explode(F.when(F.col("comp") == F.col("main"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))).drop("main")
    a = low.select("g", "band", "side", F.col("comp").alias("ca"), F.col("node").alias("a"), F.col("n").alias("an"), F.col("pos").alias("apos"))
    b = high.select("g", "band", "side", F.col("comp").alias("cb"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bpos"))
    pairs = a.join(b, ["g", "band", "side"]).where("ca <> cb and an <= bn").where(_may_link("an", "apos", "bn", "bpos", similar))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _named(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """Every row with its component, named by the smallest document id in it."""
    smallest = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    joined = smallest.join(grouped, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = joined.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = keep(joined.select("node", "comp").join(names, "comp").select("node", "component_id"))
    out = sets.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
