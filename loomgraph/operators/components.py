"""Connected components and everything built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import dense_index
from loomgraph.core.session import cut
from loomgraph.core.skew import hot_keys, lookup

BLOCK = 1 << 20  # pairs that one task may hold; rounds over more stay distributed

def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of ``u`` are re-attached to u's smallest one.

    Large stars move the larger neighbours, small stars the smaller ones.  The
    smallest neighbour is a combinable aggregate; the rows of a node with very
    many neighbours are spread by the skew-safe lookup.
    """
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    joined = lookup(both, low, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = low.where("m < u").select("u", F.col("m").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.where("u <> v").distinct()


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0 to n - 1 and edges (u, v)."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the pairs (u, v) but the smallest of its component, attached to that one."""
    held = list(batches)
    if not held:
        return
    pairs = pa.Table.from_batches(held)
    names, code = np.unique(np.concatenate([pairs.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    root = roots(len(names), code[: len(pairs)], code[len(pairs) :])
    moved = np.flatnonzero(root != np.arange(len(names)))
    schema = pairs.schema
    yield pa.RecordBatch.from_arrays([pa.array(names[moved], schema.field("u").type), pa.array(names[root[moved]], schema.field("v").type)], ["u", "v"])


def components(
    edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, max_rounds: int = 60, block: int = BLOCK
) -> DataFrame:
    """(node_id, comp): the component is named by its smallest node.

    Alternating large and small star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond") need a number of rounds logarithmic in
    the graph, whatever its diameter, and the edge set never grows.  As soon as
    ``block`` pairs or fewer are left, one task settles them as the last round.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    left, mark, settled = pairs.count(), None, False
    for _ in range(max_rounds):
        if settled:
            break
        if left <= block:
            pairs, settled = cut(pairs.coalesce(1).mapInArrow(_stars, pairs.schema)), True
            continue
        pairs = cut(_star(_star(pairs, True), False))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        left, settled, mark = now[0], tuple(now) == mark, tuple(now)
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    every = edges.select(F.col(src).alias("node_id")).unionByName(edges.select(F.col(dst).alias("node_id")))
    if nodes is not None:
        every = every.unionByName(nodes.select("node_id"))
    attached = pairs.groupBy(F.col("u").alias("node_id")).agg(F.min("v").alias("comp"))
    return every.distinct().join(attached, "node_id", "left").select("node_id", F.coalesce("comp", "node_id").alias("comp"))


def bipartite_nodes(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges with second-side ids moved behind the largest first-side id."""
    shift = edges.agg((F.max(src) + 1).alias("shift"))
    return edges.join(F.broadcast(shift)).withColumn("i", F.col(src)).withColumn("j", F.col(dst) + F.col("shift"))


def component_sizes(labels: DataFrame, min_size: int = 1) -> DataFrame:
    """Components numbered by decreasing size (ties: smaller name first)."""
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("comp_size")).where(F.col("comp_size") >= min_size)
    return dense_index(sizes, [F.desc("comp_size"), F.col("comp")], "comp_rank")


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of the largest component (ties: smaller name)."""
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.min(F.struct((-F.col("n")).alias("neg"), "comp")).alias("t")).select(F.col("t.comp").alias("comp"))
    return labels.join(F.broadcast(top), "comp", "left_semi")


def giant_fraction(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("giant_fraction"), F.count(F.lit(1)).alias("n_components"))


def within_label_components(edges: DataFrame, labels: DataFrame, src: str = "src", dst: str = "dst", min_size: int = 1) -> DataFrame:
    """Split every label into its connected pieces.

    Noise (-1) and pieces below ``min_size`` get -1; the others are numbered in
    order of (label, smallest node).
    """
    good = labels.where("label >= 0").select("node_id", "label")
    a = good.select(F.col("node_id").alias(src), F.col("label").alias("la"))
    b = good.select(F.col("node_id").alias(dst), F.col("label").alias("lb"))
    same = lookup(lookup(edges.select(src, dst), a, src), b, dst).where("la = lb")
    pieces = components(same, src, dst, nodes=good)
    joined = good.join(pieces, "node_id")
    sizes = joined.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    numbered = dense_index(sizes.select("label", "comp"), ["label", "comp"], "new_label")
    placed = lookup(joined.select("node_id", "comp"), numbered.select("comp", "new_label"), "comp", "left")
    return (
        labels.select("node_id")
        .join(placed, "node_id", "left")
        .select("node_id", F.coalesce("new_label", F.lit(-1).cast("long")).alias("label"))
    )


def relabel_contiguous(labels: DataFrame) -> DataFrame:
    """Labels renumbered 0.. in order of their value; -1 stays."""
    values = labels.where("label >= 0").select("label").distinct()
    numbered = dense_index(values, ["label"], "new_label")
    return lookup(labels, numbered, "label", "left").select("node_id", F.coalesce("new_label", F.lit(-1).cast("long")).alias("label"))


def curate_noise(edges: DataFrame, labels: DataFrame, share: float = 0.5, tol: float = 1e-4, max_rounds: int = 50) -> tuple[DataFrame, int]:
    """Noise nodes take the label of more than ``share`` of their labelled neighbours.

    ``edges`` has columns src, dst.  All nodes move at once; the loop ends when
    the share of changed nodes falls below ``tol``.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = cut(both)
    hot = hot_keys(both, "dst")
    state = cut(labels.select("node_id", "label"))
    total = state.count()
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        noise = state.where("label = -1").select(F.col("node_id").alias("src"))
        known = state.where("label >= 0").select(F.col("node_id").alias("dst"), "label")
        votes = lookup(both.join(noise, "src", "left_semi"), known, "dst", "inner", hot).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        top = votes.groupBy("src").agg(F.sum("n").alias("t"), F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("m"))
        win = top.where(F.col("m.n") > share * F.col("t")).select(F.col("src").alias("node_id"), (-F.col("m.neg")).alias("vote"))
        state = cut(state.join(win, "node_id", "left").select("node_id", F.coalesce("vote", "label").alias("label"), F.col("vote").isNotNull().alias("moved")))
        changed = state.where("moved").count()
        state = state.drop("moved")
        if total == 0 or changed / total < tol:
            break
    return state, rounds


def kcore(edges: DataFrame, k: float, weight: str | None = None, max_rounds: int = 1000) -> tuple[DataFrame, int]:
    """Nodes left after repeatedly dropping those of (weighted) degree below k."""
    w = F.col(weight) if weight else F.lit(1.0)
    half = edges.where("src <> dst").select("src", "dst", w.alias("w"))
    live = cut(half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    hot = hot_keys(live, "src")
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        weak = cut(live.groupBy("src").agg(F.sum("w").alias("d")).where(F.col("d") < k).select("src"))
        if not weak.limit(1).count():
            break
        step = lookup(live, weak, "src", "left_anti", hot)
        live = cut(lookup(step, weak.select(F.col("src").alias("dst")), "dst", "left_anti", hot))
    else:
        raise RuntimeError(f"the k-core is not settled after {max_rounds} rounds")
    return live.select(F.col("src").alias("node_id")).distinct(), rounds


