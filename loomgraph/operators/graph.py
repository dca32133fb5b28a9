"""Weighted graphs as edge tables (src, dst, w)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.core.order import dense_index
from loomgraph.core.skew import lookup


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst", w: str = "w") -> DataFrame:
    a = edges.select(F.col(src).alias("i"), F.col(dst).alias("j"), F.col(w).alias("w"))
    return a.unionByName(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def symmetrise(edges: DataFrame, how: str = "sum") -> DataFrame:
    """A + A', their maximum, or their mean; an absent entry counts as 0.

    ``edges`` is directed (i, j, w); the diagonal is left out.
    """
    flipped = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    both = edges.select("i", "j", "w").unionByName(flipped).where("i <> j")
    value = {"sum": F.sum("w"), "max": F.max("w"), "mean": F.sum("w") / 2}[how]
    return both.groupBy("i", "j").agg(value.alias("w"))


def reindex_bipartite(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Dense node numbers (first side, then second) and the renumbered edges."""
    a = dense_index(edges.select(F.col(src).alias("raw_id")).distinct(), ["raw_id"], "node_id")
    n0 = a.agg(F.count(F.lit(1)).alias("n0"))
    b = dense_index(edges.select(F.col(dst).alias("raw_id")).distinct(), ["raw_id"], "node_id")
    b = b.join(F.broadcast(n0)).select("raw_id", (F.col("node_id") + F.col("n0")).alias("node_id"))
    nodes = a.select(F.lit(0).alias("node_type"), "raw_id", "node_id").unionByName(b.select(F.lit(1).alias("node_type"), "raw_id", "node_id"))
    e = lookup(edges, a.select(F.col("raw_id").alias(src), F.col("node_id").alias("i")), src)
    e = lookup(e, b.select(F.col("raw_id").alias(dst), F.col("node_id").alias("j")), dst)
    return nodes, e


def add_extra(edges: DataFrame, extra: DataFrame, factor: float = 1e-5) -> DataFrame:
    """Further edges with a very small weight."""
    return edges.unionByName(extra.withColumn("w", F.col("w") * factor))


def degrees(sym: DataFrame) -> DataFrame:
    return sym.groupBy("i").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("n_nbr"))


def row_normalise(sym: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Rows divided by their sum; nodes without edges get a loop of weight 1."""
    d = sym.groupBy("i").agg(F.sum("w").alias("_d"))
    out = lookup(sym, d, "i").select("i", "j", (F.col("w") / F.col("_d")).alias("w"))
    if nodes is None:
        return out
    lonely = nodes.select(F.col("node_id").alias("i")).join(d, "i", "left_anti")
    return out.unionByName(lonely.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))


def top_k(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each row (ties: smaller column first).

    The rank limit is applied before the shuffle too, so a row with very many
    edges sends at most k of them from each task.
    """
    w = Window.partitionBy("i").orderBy(F.desc("w"), "j")
    return edges.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def cumulative_prune(edges: DataFrame, frac: float, k: int, min_keep: int = 1) -> DataFrame:
    """Smallest heavy prefix of each row that reaches ``frac`` of the row sum.

    At most ``k`` and at least ``min_keep`` edges; the sum is over the full row.
    """
    total = edges.groupBy("i").agg(F.sum("w").alias("row_sum"))
    top = lookup(top_k(edges, k), total, "i")
    w = Window.partitionBy("i").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(w), F.lit(0.0))
    return top.withColumn("_b", before).where((F.col("_b") < frac * F.col("row_sum")) | (F.col("pos") <= min_keep)).drop("_b")


def prune_with_slack(edges: DataFrame, k: int, frac: float = 1.0, min_keep: int = 1) -> tuple[DataFrame, DataFrame]:
    """Union-max symmetrised pruned graph and the weight each node lost."""
    full = edges.groupBy("i").agg(F.sum("w").alias("full"))
    kept = symmetrise(cumulative_prune(edges, frac, k, min_keep).select("i", "j", "w"), "max")
    have = kept.groupBy("i").agg(F.sum("w").alias("kept"))
    slack = full.join(have, "i", "left").select("i", F.greatest(F.col("full") - F.coalesce("kept", F.lit(0.0)), F.lit(0.0)).alias("slack"))
    return kept, slack


def coarsen(edges: DataFrame, member: DataFrame, diagonal: bool = False) -> DataFrame:
    """Edge weights between groups (member: node_id, super)."""
    a = member.select(F.col("node_id").alias("i"), F.col("super").alias("si"))
    b = member.select(F.col("node_id").alias("j"), F.col("super").alias("sj"))
    joined = lookup(lookup(edges, a, "i"), b, "j")
    if not diagonal:
        joined = joined.where("si <> sj")
    return joined.groupBy("si", "sj").agg(F.sum("w").alias("w"))


def coarsen_counts(counts: DataFrame, member: DataFrame, node: str, feature: str, n: str) -> DataFrame:
    m = member.select(F.col("node_id").alias(node), "super")
    return lookup(counts, m, node).groupBy("super", feature).agg(F.sum(n).alias(n))


def supernodes(labels: DataFrame, min_size: int) -> DataFrame:
    """Labels with enough members, numbered 0.. in label order (node_id, super)."""
    big = labels.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_size).select("label")
    return lookup(labels, dense_index(big, ["label"], "super"), "label").select("node_id", "super")


def centroids(points: DataFrame, member: DataFrame, coords: Sequence[str]) -> DataFrame:
    return points.join(member, "node_id").groupBy("super").agg(*[F.avg(c).alias(c) for c in coords], F.count(F.lit(1)).alias("n"))


def transport_distance(sym: DataFrame) -> DataFrame:
    """-ln(w / sqrt(si sj)), not below zero."""
    s = sym.groupBy("i").agg(F.sum("w").alias("s"))
    x = lookup(lookup(sym, s.withColumnRenamed("s", "si"), "i"), s.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
    return x.where("w > 0").select("i", "j", F.greatest(-F.log(F.col("w") / F.sqrt(F.col("si") * F.col("sj"))), F.lit(0.0)).alias("dist"))


def with_coords(edges: DataFrame, points: DataFrame, coords: Sequence[str], left: str = "i", right: str = "j") -> DataFrame:
    a = points.select(F.col("node_id").alias(left), *[F.col(c).alias(f"a_{c}") for c in coords])
    b = points.select(F.col("node_id").alias(right), *[F.col(c).alias(f"b_{c}") for c in coords])
    return lookup(lookup(edges, a, left), b, right)


def distance2(coords: Sequence[str]) -> Column:
    out = None
    for c in coords:
        diff = F.col(f"a_{c}") - F.col(f"b_{c}")
        out = diff * diff if out is None else out + diff * diff
    return out


def adaptive_gaussian(sym: DataFrame, points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Edge weights times s^(-d/2) exp(-r^2 / s), s = half the endpoints' dispersions.

    The dispersion of a node is the weighted mean squared length of its edges;
    nodes without one take the mean of the others.
    """
    e = with_coords(sym, points, coords).select("i", "j", "w", distance2(coords).alias("d2"))
    spread = e.where("w > 0").groupBy("i").agg((F.sum(F.col("w") * F.col("d2")) / F.sum("w")).alias("s2"))
    fallback = spread.where("s2 > 0").agg(F.coalesce(F.avg("s2"), F.lit(1.0)).alias("fb"))
    s = spread.join(F.broadcast(fallback)).select("i", F.when(F.col("s2") > 0, F.col("s2")).otherwise(F.col("fb")).alias("s2"), "fb")
    x = lookup(lookup(e, s, "i"), s.select(F.col("i").alias("j"), F.col("s2").alias("t2")), "j")
    half = F.greatest(0.5 * (F.col("s2") + F.col("t2")), F.greatest(F.lit(1e-12), F.col("fb") * 1e-12))
    return x.select("i", "j", (F.col("w") * F.exp(-0.5 * len(coords) * F.log(half) - F.col("d2") / half)).alias("w"))


def fallback_edges(sym: DataFrame, neighbours: DataFrame, least: int, factor: float) -> DataFrame:
    """Rows with fewer than ``least`` edges get their nearest missing neighbours.

    Weight: the row's smallest weight (1 without any) times ``factor``.
    """
    d = sym.groupBy("i").agg(F.count(F.lit(1)).alias("have"), F.min("w").alias("low"))
    cand = neighbours.select(F.col("node_id").alias("i"), F.col("nbr").alias("j"), "rank").join(d, "i", "left")
    cand = cand.where(F.coalesce("have", F.lit(0)) < least).join(sym.select("i", "j"), ["i", "j"], "left_anti")
    w = Window.partitionBy("i").orderBy("rank")
    take = cand.withColumn("p", F.row_number().over(w)).where(F.col("p") <= least - F.coalesce("have", F.lit(0)))
    return take.select("i", "j", (F.coalesce("low", F.lit(1.0)) * factor).alias("w"))


def fallback_distances(distances: DataFrame, neighbours: DataFrame, least: int, fill: float, comp: DataFrame | None = None) -> DataFrame:
    """Weak edges (i, j, d) that give rows of a distance graph ``least`` entries.

    A row short of entries takes its nearest missing neighbours (node_id, nbr,
    rank), inside its own component where ``comp`` (node_id, comp) is given.
    Edges are added both ways; where both ends add the same one ``fill`` counts twice.
    """
    if fill <= 0:
        raise ValueError("fill must be positive")
    near = neighbours.select(F.col("node_id").alias("i"), F.col("nbr").alias("j"), "rank").where("i <> j")
    have = distances.groupBy("i").agg(F.count(F.lit(1)).alias("have"))
    near = near.join(have, "i", "left").withColumn("lack", least - F.coalesce("have", F.lit(0))).where("lack > 0")
    if comp is not None:
        a = comp.select(F.col("node_id").alias("i"), F.col("comp").alias("ci"))
        near = lookup(lookup(near, a, "i"), a.select(F.col("i").alias("j"), F.col("ci").alias("cj")), "j").where("ci = cj")
    missing = near.join(distances.select("i", "j"), ["i", "j"], "left_anti")
    w = Window.partitionBy("i").orderBy("rank", "j")  # as many rows as a node has listed neighbours
    added = missing.withColumn("p", F.row_number().over(w)).where("p <= lack").select("i", "j")
    both = added.unionByName(added.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return both.groupBy("i", "j").agg((F.count(F.lit(1)) * F.lit(float(fill))).alias("d"))

def node_statistics(sym: DataFrame, points: DataFrame, coords: Sequence[str]) -> DataFrame:
    e = with_coords(sym, points, coords).withColumn("d2", distance2(coords))
    return e.groupBy("i").agg(
        F.sum("w").alias("weighted_degree"), F.count(F.lit(1)).alias("degree"), F.sqrt(F.sum(F.col("w") * F.col("d2")) / F.sum("w")).alias("rmsd")
    )


def distance_histogram(upper: DataFrame, points: DataFrame, coords: Sequence[str], width: float, bins: int) -> DataFrame:
    """Weight per distance bin; the last bin takes everything beyond."""
    e = with_coords(upper, points, coords)
    b = F.least(F.floor(F.sqrt(distance2(coords)) / width), F.lit(bins)).cast("long")
    return e.groupBy(b.alias("bin")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def rewire(edges: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Move an exact share of the edge occurrences to a wrong partner on the same side.

    Occurrences are drawn without replacement in hash order; a coin keeps one
    endpoint and the other becomes a different node of its side.  Node numbers
    of each side must be dense (0..n-1).
    """

    def draw(tag: int) -> Column:
        return F.xxhash64("i", "j", "copy", F.lit(seed), F.lit(tag))

    n = edges.agg((F.max("i") + 1).alias("ni"), (F.max("j") + 1).alias("nj"), F.floor(F.sum("w") * fraction).alias("take"))
    occ = edges.where("w >= 1").select("i", "j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w").cast("long"))).alias("copy")).withColumn("h", draw(1))
    placed = dense_index(occ, ["h", "i", "j", "copy"], "place").join(F.broadcast(n))
    chosen = F.col("place") < F.col("take")
    keep_i = F.pmod(draw(2), F.lit(2)) == 0
    new_j = F.pmod(F.col("j") + 1 + F.pmod(draw(3), F.greatest(F.col("nj") - 1, F.lit(1))), F.col("nj"))
    new_i = F.pmod(F.col("i") + 1 + F.pmod(draw(3), F.greatest(F.col("ni") - 1, F.lit(1))), F.col("ni"))
    moved = placed.select(
        F.when(chosen & ~keep_i, new_i).otherwise(F.col("i")).alias("i"), F.when(chosen & keep_i, new_j).otherwise(F.col("j")).alias("j")
    )
    return moved.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("w"))


def fuse(edges: DataFrame, donors: DataFrame, side: str) -> DataFrame:
    """Edges of donor nodes go to their receiver (donors: node_id, receiver)."""
    d = donors.select(F.col("node_id").alias(side), "receiver")
    moved = lookup(edges, d, side, "left").withColumn(side, F.coalesce("receiver", F.col(side))).drop("receiver")
    return moved.groupBy("i", "j").agg(F.sum("w").alias("w"))


def link_list(sym: DataFrame) -> DataFrame:
    """Upper triangle with 1-based numbers as text lines."""
    return sym.where("i < j").select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("w").cast("string")).alias("value"))
