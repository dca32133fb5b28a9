"""Registration of an aggregate graph on a slice, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.operators import knn as N
from loomgraph.operators import registration as R
from loomgraph.operators import transport as X


@dataclass
class Registration:
    base: DataFrame  # node_id, slice, coordinates before refinement
    final: DataFrame
    rounds: int


def candidate_arcs(nodes: DataFrame, slices: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """The k slice nodes with the nearest features, with Huber costs."""
    near = N.knn(nodes, k, features, targets=slices)
    a = nodes.select(F.col("node_id"), *[F.col(f).alias(f"a_{f}") for f in features])
    b = slices.select(F.col("node_id").alias("nbr"), *[F.col(f).alias(f"b_{f}") for f in features])
    arcs = lookup(lookup(near.select("node_id", "nbr"), a, "node_id"), b, "nbr")
    return R.huber_costs(arcs, features).select(F.col("node_id").alias("a"), F.col("nbr").alias("b"), "cost")


def neighbour_candidates(edges: DataFrame, placed: DataFrame, slices: DataFrame, coords: Sequence[str], k: int) -> DataFrame:
    """Slice nodes nearest to the mean place of a node's graph neighbours."""
    p = placed.select(F.col("node_id").alias("j"), *coords)
    centre = lookup(edges, p, "j").groupBy(F.col("i").alias("node_id")).agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in coords])
    return N.knn(centre, k, coords, targets=slices).select(F.col("node_id").alias("a"), F.col("nbr").alias("b"))


def _place(assigned: DataFrame, slices: DataFrame, coords: Sequence[str]) -> DataFrame:
    s = slices.select(F.col("node_id").alias("b"), *coords)
    return lookup(assigned.select("a", "b"), s, "b").select(F.col("a").alias("node_id"), F.col("b").alias("slice"), *coords)


def solve(arcs: DataFrame, caps: DataFrame, resolution: float = 100.0, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """Auction on costs rounded to ``resolution`` levels; coarser levels need fewer rounds.

    An auction that goes on beyond its rounds is left for the exact optimum of these levels.
    """
    top = arcs.agg(F.max("cost")).first()[0] or 1.0
    units = arcs.select("a", "b", F.round(F.col("cost") / float(top) * resolution).cast("long").alias("unit_cost"))
    brief = X.may_settle(caps, 1)
    try:
        got, rest, _ = X.auction(units, caps, step=step, exact=False, max_rounds=X.AUCTION_ROUNDS if brief else 1_000)
    except X.StillBidding:
        if not brief:
            raise
        units = cut(units)
        cols = cut(caps.where("capacity > 0").select("b", "capacity"))
        found = X.settled(cut(units.join(cols.select("b"), "b", "left_semi")), cols)
        return found.assigned, found.rest
    return got, rest


def _all_placed(rest: DataFrame) -> None:
    if rest.limit(1).count():
        raise ValueError("the places' capacities leave nodes without a place")


def register(
    nodes: DataFrame, slices: DataFrame, edges: DataFrame, caps: DataFrame, features: Sequence[str], coords: Sequence[str], k: int = 8, refine: int = 2, strength: float = 1.0,
    resolution: float = 100.0, step: int = 1,
) -> Registration:
    """Assign nodes to slice nodes by features, then smooth over the graph.

    Blocked rows get more candidates until all are placed.  A refinement adds
    the neighbours' places as candidates and their Dirichlet penalty to the
    costs; it stops when no node moves.
    """
    nodes, slices, caps = cut(nodes), cut(slices), cut(caps.withColumnRenamed("node_id", "b"))
    n_slices = slices.count()
    arcs = cut(candidate_arcs(nodes, slices, features, min(k, n_slices)))
    while True:
        got, rest = solve(arcs, caps, resolution, step)
        rest = cut(rest)
        if not rest.limit(1).count() or k >= n_slices:
            break
        k = X.grow_candidates(k, n_slices)
        wider = candidate_arcs(lookup(nodes, rest.select(F.col("a").alias("node_id")), "node_id", "left_semi"), slices, features, k)
        arcs = cut(arcs.join(rest, "a", "left_anti").unionByName(wider))
    _all_placed(rest)
    base = placed = cut(_place(got, slices, coords))
    done = 0
    feats = nodes.select(F.col("node_id").alias("a"), *[F.col(f).alias(f"a_{f}") for f in features])
    where = slices.select(F.col("node_id").alias("b"), *[F.col(f).alias(f"b_{f}") for f in features], *[F.col(c).alias(f"y_{c}") for c in coords])
    for _ in range(refine):
        done += 1
        more = arcs.select("a", "b").unionByName(neighbour_candidates(edges, placed, slices, coords, min(8, n_slices))).distinct()
        costed = R.huber_costs(lookup(lookup(more, feats, "a"), where, "b"), features)
        pen = cut(R.dirichlet_penalty(costed, edges, placed, coords).select("a", "b", "cost", "penalty"))
        weight = R.adaptive_weight(pen).first()[0] or 0.0
        got, rest = solve(pen.select("a", "b", (F.col("cost") + F.col("penalty") * float(weight * strength)).alias("cost")), caps, resolution, step)
        _all_placed(rest)
        new = cut(_place(got, slices, coords))
        old = placed.select("node_id", F.col("slice").alias("before"))
        moved = new.join(old, "node_id").where("slice <> before").limit(1).count()
        placed = new
        if not moved:
            break
    return Registration(base, placed, done)
