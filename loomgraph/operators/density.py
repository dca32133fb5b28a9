"""Density clustering: mutual reachability, spanning forest, labels of the exact hierarchy."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.core.order import group_index
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.operators import graph as G
from loomgraph.operators import knn as N
from loomgraph.operators.components import BLOCK, components, curate_noise, relabel_contiguous
from loomgraph.operators.hierarchy import stable_labels


def mutual_reachability(points: DataFrame, coords: Sequence[str], min_samples: int) -> DataFrame:
    """Edges (i, j, d) of the neighbour graph with d = max(core i, core j, distance)."""
    near = N.knn(points, min_samples, coords)
    return reachability_of(near.select(F.col("node_id").alias("i"), F.col("nbr").alias("j"), F.col("dist").alias("d")), min_samples)


def reachability_of(distances: DataFrame, min_samples: int) -> DataFrame:
    """The same from sparse distances (i, j, d); core is the k-th smallest of a row."""
    distances = cut(distances)
    w = Window.partitionBy("i").orderBy("d", "j")
    near = distances.withColumn("r", F.row_number().over(w)).where(F.col("r") <= min_samples)
    core = cut(near.groupBy("i").agg(F.max("d").alias("core")))
    e = distances.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("d").alias("d"))
    x = lookup(lookup(e, core, "i", "left"), core.select(F.col("i").alias("j"), F.col("core").alias("cj")), "j", "left")
    return x.select("i", "j", F.greatest("d", F.coalesce("core", "d"), F.coalesce("cj", "d")).alias("d"))


def _lightest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (i, j, d) that join parts (ci, cj), taken in order of (d, i, j)."""
    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held)
    i, j, ci, cj = (edges.column(c).to_numpy() for c in ("i", "j", "ci", "cj"))
    known = edges.column("d").is_valid().to_numpy()  # as in Spark, a missing length comes first and NaN last
    _, code = np.unique(np.concatenate([ci, cj]), return_inverse=True)
    order = np.lexsort((j, i, edges.column("d").to_numpy(), known))
    up, take = list(range(len(code))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for row, x, y in zip(order.tolist(), code[: len(i)][order].tolist(), code[len(i) :][order].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            take.append(row)
    yield from edges.select(["i", "j", "d"]).take(pa.array(take, pa.int64())).to_batches()


def spanning_forest(edges: DataFrame, max_rounds: int = 40, block: int = BLOCK) -> DataFrame:
    """Minimum spanning forest by Boruvka rounds (ties: smaller endpoints).

    Each round every component picks its lightest outgoing edge with one
    combinable minimum; the number of components at least halves.  When
    ``block`` edges or fewer still join components, one task orders them.
    """
    live = cut(edges.select("i", "j", "d", F.col("i").alias("ci"), F.col("j").alias("cj")).where("i <> j"))
    chosen = live.select("i", "j", "d").limit(0)
    for _ in range(max_rounds):
        if live.count() <= block:
            chosen = cut(chosen.unionByName(live.coalesce(1).mapInArrow(_lightest, chosen.schema)))
            break
        ends = live.select(F.col("ci").alias("c"), "d", "i", "j").unionByName(live.select(F.col("cj").alias("c"), "d", "i", "j"))
        pick = cut(ends.groupBy("c").agg(F.min(F.struct("d", "i", "j")).alias("m")).select("m.i", "m.j", "m.d").distinct())
        chosen = cut(chosen.unionByName(pick))
        joined = live.join(pick.select("i", "j"), ["i", "j"], "left_semi").select("ci", "cj")
        label = components(joined, "ci", "cj")
        x = lookup(live, label.select(F.col("node_id").alias("ci"), F.col("comp").alias("a")), "ci", "left")
        x = lookup(x, label.select(F.col("node_id").alias("cj"), F.col("comp").alias("b")), "cj", "left")
        live = cut(x.select("i", "j", "d", F.coalesce("a", "ci").alias("ci"), F.coalesce("b", "cj").alias("cj")).where("ci <> cj"))
    else:
        raise RuntimeError(f"the forest is not done after {max_rounds} rounds")
    return chosen


def density_clusters(forest: DataFrame, nodes: DataFrame, min_size: int) -> DataFrame:
    """(node_id, label): most stable clusters of the forest's hierarchy, -1 noise."""
    return stable_labels(forest, nodes, min_size)


def cluster_points(points: DataFrame, coords: Sequence[str], min_size: int = 50, min_samples: int = 50) -> DataFrame:
    forest = spanning_forest(mutual_reachability(points, coords, min_samples))
    return density_clusters(forest, points.select("node_id"), min_size)


def cluster_distances(distances: DataFrame, nodes: DataFrame, min_size: int, min_samples: int) -> DataFrame:
    """Clusters of a sparse distance graph (i, j, d)."""
    forest = spanning_forest(reachability_of(distances, min_samples))
    return density_clusters(forest, nodes, min_size)


def component_reachability(distances: DataFrame, min_samples: int, self_distance: float) -> DataFrame:
    """Edges (i, j, d) of a symmetric distance graph with the core places of its components.

    A node is its own first neighbour, at ``self_distance``.  The core is the
    distance in place ``min_samples`` + 1, or in a later place's stead the last
    one that every node of the component has (at least the second).
    """
    distances = cut(distances.where("i <> j").select("i", "j", F.greatest("d", F.lit(self_distance)).alias("d")))
    comp = cut(components(distances, "i", "j").withColumnRenamed("node_id", "i"))
    rows = distances.groupBy("i").agg((F.count(F.lit(1)) + 1).alias("n"))
    per = lookup(rows, comp, "i").groupBy("comp").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("size"))
    place = F.greatest(F.lit(2), F.least(F.lit(max(2, min_samples + 1)), "size", "least"))
    wanted = cut(lookup(comp, per.select("comp", place.alias("place")), "comp").select("i", "place"))
    ranked = group_index(distances, ["i"], [F.col("i"), F.col("d"), F.col("j")], "pos")
    core = cut(lookup(ranked, wanted, "i").where("pos = place - 2").select("i", F.col("d").alias("core")))
    e = distances.where("i < j")
    x = lookup(lookup(e, core, "i"), core.select(F.col("i").alias("j"), F.col("core").alias("cj")), "j")
    return x.select("i", "j", F.greatest("d", "core", "cj").alias("d"))


def cluster_transport(weights: DataFrame, nodes: DataFrame, min_size: int = 50, min_samples: int = 50, eps: float = 1e-12) -> DataFrame:
    """(node_id, label): density clusters of -log transport weights, component by component.

    ``weights`` (i, j, w) is made symmetric with the larger weight; self edges
    do not count.  Distances lie between ``eps`` and -ln(``eps``).  A component
    that has no stabler parts is a cluster itself.  Noise then takes the
    majority label of its neighbours, and labels are numbered from 0.  Nodes
    without an edge are noise.
    """
    pruned = cut(G.symmetrise(weights.where("i <> j and w > 0"), "max"))
    d = F.least(F.greatest("dist", F.lit(eps)), F.lit(-math.log(eps)))
    reach = component_reachability(G.transport_distance(pruned).select("i", "j", d.alias("d")), min_samples, eps)
    labels = stable_labels(spanning_forest(reach), nodes, min_size, "always")
    return curated(labels, pruned)


def curated(labels: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Noise takes the majority label of its neighbours (i, j) until it rests; labels from 0."""
    revised, _ = curate_noise(adjacency.select(F.col("i").alias("src"), F.col("j").alias("dst")), labels)
    return relabel_contiguous(revised)


def segment(
    points: DataFrame | None,
    coords: Sequence[str],
    adjacency: DataFrame | None,
    which: str = "both",
    min_size: int = 50,
    min_samples: int = 50,
    **community_options,
) -> DataFrame:
    """(node_id, density_label, map_label), -1 where a way is not asked for.

    ``which`` is "density" (clusters of the points, curated on ``adjacency``),
    "map" (communities of ``adjacency`` by the map equation, those below
    ``min_size`` noise) or "both".
    """
    if which not in ("density", "map", "both"):
        raise ValueError(f"which: density, map or both, not {which}")
    if adjacency is None or (points is None and which != "map"):
        raise ValueError(f"{which} needs an adjacency" + ("" if which == "map" else " and points"))
    if points is not None:
        nodes = points.select("node_id")
    else:
        nodes = adjacency.select(F.col("i").alias("node_id")).unionByName(adjacency.select(F.col("j").alias("node_id"))).distinct()
    out = nodes.withColumn("density_label", F.lit(-1).cast("long")) if which == "map" else (
        curated(cluster_points(points, coords, min_size, min_samples), adjacency).withColumnRenamed("label", "density_label")
    )
    if which == "density":
        return out.withColumn("map_label", F.lit(-1).cast("long"))
    from loomgraph.operators.communities import communities

    found = communities(adjacency, "map", **community_options)
    large = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("label")
    kept = relabel_contiguous(lookup(found, large, "label").select("node_id", "label")).withColumnRenamed("label", "map_label")
    return out.join(kept, "node_id", "left").fillna(-1, ["map_label"])
