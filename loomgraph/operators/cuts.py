"""Spectral sweep cuts, for all blocks of a partition at once.

``sym`` is an edge table (i, j, w) with both directions and no edge between
blocks; a block is a connected piece named by its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import dense_index, running_sums
from loomgraph.core.session import cut
from loomgraph.core.skew import hot_keys, lookup
from loomgraph.operators.components import components, kcore, roots
from loomgraph.operators.linear import apply

EDGES = 1 << 22  # edges that one task may cut through all levels; levels over more stay distributed
SEED = 1  # of the start vectors
KCORE_ROUNDS = 1_000


def _start(seed: int) -> Column:
    return F.pmod(F.xxhash64("node_id", F.lit(seed)), F.lit(2_000_003)) / 1_000_001.5 - 1.0


def sweep(sym: DataFrame, scores: DataFrame, min_side: int = 1) -> DataFrame:
    """Cut weight and conductance of every prefix of every block.

    ``scores`` is (node_id, block, score); the order is (score, node) inside a
    block.  An edge adds its weight when its first endpoint enters the prefix
    and takes it away with the second, so a block's cut weights sum to nothing
    and one running sum over the whole order serves all blocks.
    """
    placed = cut(dense_index(scores.select("node_id", "block", "score"), ["block", "score", "node_id"], "place"))
    a = placed.select(F.col("node_id").alias("i"), F.col("place").alias("pi"))
    b = placed.select(F.col("node_id").alias("j"), F.col("place").alias("pj"))
    e = lookup(lookup(sym.where("i <> j"), a, "i"), b, "j")
    sign = F.when(F.col("pj") > F.col("pi"), 1).otherwise(-1)
    delta = e.groupBy(F.col("i").alias("node_id")).agg(
        F.sum("w").alias("degree"), F.sum(F.col("w") * sign).alias("d_w"), F.sum(sign).cast("long").alias("d_e")
    )
    rows = placed.join(delta, "node_id", "left").na.fill(0.0, ["degree", "d_w"]).na.fill(0, ["d_e"])
    summed = cut(running_sums(rows, ["place"], {"d_w": "w_before", "d_e": "e_before", "degree": "v_before"}))
    heads = summed.groupBy("block").agg(
        F.min("place").alias("head"), F.min_by("v_before", "place").alias("v_head"), F.min_by("w_before", "place").alias("w_head"),
        F.sum("degree").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    x = lookup(summed, heads, "block")
    pos = F.col("place") - F.col("head")
    left = F.col("v_before") - F.col("v_head") + F.col("degree")
    small = F.least(left, F.col("volume") - left)
    weight = F.col("w_before") - F.col("w_head") + F.col("d_w")
    ok = (small > 1e-9) & (pos + 1 >= min_side) & (F.col("n") - pos - 1 >= min_side)
    return x.select(
        "node_id", "block", pos.alias("pos"), weight.alias("cut_weight"), (F.col("e_before") + F.col("d_e")).alias("cut_edges"),
        F.when(ok, weight / small).alias("conductance"), "n",
    )


def best_cuts(swept: DataFrame) -> DataFrame:
    """Per block the prefix of smallest conductance (the first on ties)."""
    best = swept.where("conductance IS NOT NULL").groupBy("block").agg(F.min(F.struct("conductance", "pos", "cut_edges", "cut_weight", "n")).alias("b"))
    return best.select("block", "b.*")


def second_vectors(sym: DataFrame, nodes: DataFrame, rounds: int = 12, inner: int = 5, tol: float = 1e-4, seed: int = SEED) -> DataFrame:
    """(node_id, block, score): second eigenvector of each block, as D^-1/2 x.

    Power iteration on the normalised adjacency, made positive by a loop on
    every node.  After ``inner`` products the trivial vector sqrt(degree) is
    projected out and the length reset, per block.  A product is one join of
    edges and vector and one sum per node.
    """
    e = sym.where("i <> j").select("i", "j", "w")
    root = e.groupBy(F.col("i").alias("node_id")).agg(F.sqrt(F.sum("w")).alias("t"))
    deg = cut(nodes.select("node_id", "block").join(root, "node_id"))
    ti = deg.select(F.col("node_id").alias("i"), F.col("t").alias("ti"))
    tj = deg.select(F.col("node_id").alias("j"), F.col("t").alias("tj"))
    half = lookup(lookup(e, ti, "i"), tj, "j").select("i", "j", (F.col("w") / (F.col("ti") * F.col("tj")) / 2).alias("w"))
    walk = cut(half.unionByName(deg.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(0.5).alias("w"))))
    hot_edge, hot_block = hot_keys(walk, "j"), hot_keys(deg, "block")
    t, x = F.col("t"), F.col("x")
    state = deg.withColumn("x", _start(seed))
    before = None
    for _ in range(rounds):
        sums = state.groupBy("block").agg(F.sum(x * x).alias("xx"), F.sum(t * x).alias("tx"), F.sum(t * t).alias("tt"))
        left = F.greatest(F.col("xx") - F.col("tx") * F.col("tx") / F.col("tt"), F.lit(1e-300))
        sums = cut(sums.select("block", (F.col("tx") / F.col("tt")).alias("m"), F.sqrt(left).alias("s")))
        unit = lookup(state, sums, "block", "inner", hot_block).select("node_id", ((x - t * F.col("m")) / F.col("s")).alias("x"))
        for _ in range(inner):
            unit = apply(walk, unit, ["x"], hot_edge)
        state = cut(deg.join(unit, "node_id"))
        value = sums.agg(F.sum("s")).first()[0] or 0.0  # sum of the blocks' growth rates
        if before is not None and abs(value - before) <= tol * max(1.0, abs(value)):
            break
        before = value
    return state.select("node_id", "block", (x / t).alias("score"))


def sparsest_cut_blocks(
    sym: DataFrame,
    min_size: int,
    threshold: float = 0.25,
    min_within: float = 0.0,
    stopping_assoc: int | None = None,
    max_size: int | None = None,
    max_depth: int = 60,
    most: int = EDGES,
) -> DataFrame:
    """(node_id, block): recursive sparsest cuts, level by level.

    A block below twice ``min_size`` is final.  It also stays whole when its best
    conductance reaches ``threshold`` and, where given, the cut has at least
    ``stopping_assoc`` edges and the block at most ``max_size`` nodes.  After a
    cut, nodes tied to their side by less than ``min_within`` become single
    blocks and each side falls into its connected components.  As soon as ``most``
    edges or fewer are left, one task takes the same steps through the last levels.
    """
    nodes = cut(components(sym, "i", "j").withColumnRenamed("comp", "block"))
    edges = cut(sym.where("i <> j").select("i", "j", "w"))
    final = None
    for depth in range(max_depth):
        if edges.count() <= most and nodes.count() <= most:
            levels = _Levels(min_size, threshold, min_within, stopping_assoc, max_size, max_depth - depth)
            known = nodes.where("node_id is not null")
            rows = known.select(F.col("node_id").alias("i"), F.col("block").alias("j"), F.lit(None).cast("double").alias("w"), _start(SEED).alias("x"))
            both = rows.unionByName(edges.select("i", "j", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"), F.lit(None).cast("double").alias("x")))
            found = both.coalesce(1).mapInArrow(levels, rows.select(F.col("i").alias("node_id"), F.col("j").alias("block")).schema)
            last = nodes.where("node_id is null").select("node_id", "block").unionByName(found)
            return cut(last if final is None else final.unionByName(last))
        sizes = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        small = sizes.where(F.col("n") < 2 * min_size).select("block")
        done = lookup(nodes, small, "block", "left_semi")
        nodes = cut(lookup(nodes, small, "block", "left_anti"))
        edges = _inside(edges, nodes)
        swept = None
        if nodes.limit(1).count():
            edges = cut(edges)
            swept = cut(sweep(edges, second_vectors(edges, nodes), min_size))
            stop = F.col("conductance") >= threshold
            if stopping_assoc is not None:
                stop = stop & (F.col("cut_edges") >= stopping_assoc)
            if max_size is not None:
                stop = stop & (F.col("n") <= max_size)
            splits = cut(best_cuts(swept).where(~stop).select("block", F.col("pos").alias("at")))
            done = done.unionByName(lookup(nodes, splits.select("block"), "block", "left_anti"))
        final = done if final is None else final.unionByName(done)
        final = cut(final)
        if swept is None or not splits.limit(1).count():
            return final
        sides = cut(lookup(swept.select("node_id", "block", "pos"), splits, "block").select("node_id", "block", (F.col("pos") <= F.col("at")).alias("left")))
        a = sides.select(F.col("node_id").alias("i"), F.col("block").alias("bi"), F.col("left").alias("li"))
        b = sides.select(F.col("node_id").alias("j"), F.col("left").alias("lj"))
        edges = cut(lookup(lookup(edges, a, "i"), b, "j").where("li = lj").select("i", "j", "w"))
        alive = sides.select("node_id")
        if min_within > 0:
            half = edges.where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), "w")
            alive = cut(kcore(half, min_within, "w")[0])
            alone = sides.join(alive, "node_id", "left_anti").select("node_id", F.col("node_id").alias("block"))
            final = final.unionByName(alone)
            edges = cut(_inside(edges, alive))
        nodes = cut(components(edges, "i", "j", nodes=alive).withColumnRenamed("comp", "block"))
    return final.unionByName(nodes)


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = lookup(edges, nodes.select(F.col("node_id").alias("i")), "i", "left_semi")
    return lookup(a, nodes.select(F.col("node_id").alias("j")), "j", "left_semi")


class _Levels:
    """The levels of ``sparsest_cut_blocks`` on a graph that one task holds.

    Takes rows (node, block, null, start) and edges (i, j, w, null), gives
    (node_id, block).  All blocks go through a level side by side, as they do in
    the distributed steps.
    """

    def __init__(self, min_size: int, threshold: float, min_within: float, stopping_assoc: int | None, max_size: int | None, depth: int):
        self.min_size, self.threshold, self.min_within = min_size, threshold, min_within
        self.stopping_assoc, self.max_size, self.depth = stopping_assoc, max_size, depth

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        is_node = table.column("x").is_valid()
        rows, edges = table.filter(is_node), table.filter(table.column("w").is_valid())
        types = [table.schema.field("i").type, table.schema.field("j").type]
        name, at = np.unique(rows.column("i").to_numpy(), return_index=True)
        start, block = rows.column("x").to_numpy()[at], rows.column("j").to_numpy()[at]
        i, j = edges.column("i").to_numpy(), edges.column("j").to_numpy()
        inside = (i != j) & np.isin(i, name) & np.isin(j, name)
        i, j, w = np.searchsorted(name, i[inside]), np.searchsorted(name, j[inside]), edges.column("w").to_numpy()[inside]
        del table, rows, edges
        order = np.lexsort((w, j, i))
        found = self._levels(name, np.searchsorted(name, block), start, i[order].astype(np.int32), j[order].astype(np.int32), w[order])
        nodes, blocks = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(name[nodes], types[0]), pa.array(name[blocks], types[1])], ["node_id", "block"])

    def _levels(self, name: np.ndarray, block: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Nodes and their blocks, by place in ``name``; a block is named by a node."""
        n = len(name)
        final = []
        live = np.ones(n, bool)
        for _ in range(self.depth):
            small = np.bincount(block[live], minlength=n) < 2 * self.min_size
            done = live & small[block]
            live = live & ~done
            if not live.any():
                final.append((np.flatnonzero(done), block[done]))
                return final
            stays = live[i] & live[j]
            i, j, w = i[stays], j[stays], w[stays]
            node, pos, at = self._splits(block, start, i, j, w)
            done = done | (live & (at[block] < 0))
            final.append((np.flatnonzero(done), block[done]))
            if not (at >= 0).any():
                return final
            side = np.full(n, -1)
            side[node] = np.where(at[block[node]] < 0, -1, pos <= at[block[node]])
            stays = (side[i] >= 0) & (side[i] == side[j])
            i, j, w = i[stays], j[stays], w[stays]
            live = side >= 0
            if self.min_within > 0:
                tied = _kcore(n, i, j, w, self.min_within)
                alone = np.flatnonzero(live & ~tied)
                final.append((alone, alone))
                live = live & tied
                stays = live[i] & live[j]
                i, j, w = i[stays], j[stays], w[stays]
            block = roots(n, i, j)
        final.append((np.flatnonzero(live), block[live]))
        return final

    def _splits(self, block: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with edges and their place in the order of their block, and the last place of the left side of each block that is cut, else -1."""
        n = len(block)
        degree = np.bincount(i, weights=w, minlength=n)
        node = np.unique(i)
        score = _second_vector(block, start, node, degree, i, j, w)
        order = np.lexsort((node, score, block[node]))
        node = node[order]
        own = block[node]
        place = np.empty(n, np.int64)
        place[node] = np.arange(len(node))
        sign = np.where(place[j] > place[i], 1, -1)
        new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.r_[head, len(node)])

        def summed(values: np.ndarray) -> np.ndarray:  # over the block up to each node
            total = np.cumsum(values)
            return total - (total - values)[head][group]

        weight, crossing = summed(np.bincount(i, weights=w * sign, minlength=n)[node]), summed(np.rint(np.bincount(i, weights=sign, minlength=n)[node]).astype(np.int64))
        left, volume = summed(degree[node]), np.add.reduceat(degree[node], head)[group] if len(head) else np.zeros(0)
        least = np.minimum(left, volume - left)
        pos = np.arange(len(node)) - head[group]
        ok = (least > 1e-9) & (pos + 1 >= self.min_size) & (size[group] - pos - 1 >= self.min_size)
        conductance = np.full(len(node), np.inf)
        conductance[ok] = weight[ok] / least[ok]
        best = np.lexsort((pos, conductance, own))[head] if len(head) else head
        best = best[ok[best]]
        stop = conductance[best] >= self.threshold
        if self.stopping_assoc is not None:
            stop = stop & (crossing[best] >= self.stopping_assoc)
        if self.max_size is not None:
            stop = stop & (size[group[best]] <= self.max_size)
        at = np.full(n, -1)
        at[own[best[~stop]]] = pos[best[~stop]]
        return node, pos, at


def _second_vector(block: np.ndarray, start: np.ndarray, node: np.ndarray, degree: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, rounds: int = 12, inner: int = 5, tol: float = 1e-4) -> np.ndarray:
    """The scores of ``second_vectors`` for the nodes with edges, by the same products and rounds."""
    n = len(block)
    t = np.sqrt(degree)
    half = w / (t[i] * t[j]) / 2
    t, x = t[node], start[node]
    _, group = np.unique(block[node], return_inverse=True)
    tt = np.bincount(group, weights=t * t)
    before = None
    for _ in range(rounds):
        tx = np.bincount(group, weights=t * x)
        left = np.maximum(np.bincount(group, weights=x * x) - tx * tx / tt, 1e-300)
        size = np.sqrt(left)
        x = (x - t * (tx / tt)[group]) / size[group]
        wide = np.zeros(n)
        for _ in range(inner):
            wide[node] = x
            x = np.bincount(i, weights=half * wide[j], minlength=n)[node] + 0.5 * x
        value = float(size.sum())
        if before is not None and abs(value - before) <= tol * max(1.0, abs(value)):
            break
        before = value
    return x / t


def _kcore(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: float) -> np.ndarray:
    """Which nodes ``kcore`` leaves of the edges with i < j."""
    ahead = i < j
    u, v, w = np.r_[i[ahead], j[ahead]], np.r_[j[ahead], i[ahead]], np.r_[w[ahead], w[ahead]]
    for _ in range(KCORE_ROUNDS):
        has = np.bincount(u, minlength=n) > 0
        weak = has & (np.bincount(u, weights=w, minlength=n) < k)
        if not weak.any():
            return has
        stays = ~(weak[u] | weak[v])
        u, v, w = u[stays], v[stays], w[stays]
    raise RuntimeError(f"the k-core is not settled after {KCORE_ROUNDS} rounds")
