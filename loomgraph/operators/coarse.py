"""The final coarsening in one flow: labels to supernodes, graphs, centroids and counts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import dense_index
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.operators import graph as G
from loomgraph.operators.components import components


class CoarseFlow(NamedTuple):
    member: DataFrame  # (node_id, super), all supernodes
    index: DataFrame  # (super, i, size), those of the largest component
    links: DataFrame  # (i, j, w)
    transport: DataFrame  # (i, j, w)
    centroids: DataFrame  # (i, coordinates, n)
    counts: DataFrame | None  # (i, gene, n)


def coarse_flow(
    labels: DataFrame,
    links: DataFrame,
    transport: DataFrame,
    points: DataFrame,
    coords: Sequence[str],
    counts: DataFrame | None = None,
    threshold: int = 1,
) -> CoarseFlow:
    """Labelled nodes become supernodes; what hangs together by links is kept.

    Every label from 0 up is a supernode, in order of labels.  Links and
    transport weights (i, j, w) are summed between different supernodes.  The
    component with most fine nodes (ties: the one with the smallest supernode)
    stays, its supernodes numbered ``i`` = 0.. in their order.  Centroids are
    means of member coordinates.  ``counts`` (node_id, gene, n) gives for each
    supernode the members whose n is ``threshold`` or more.  Members are looked
    up by node and summed map-side before they move, so a label that holds a
    third of the nodes is one row a task; the driver sees nothing.  Nodes with
    label -1 or null take no part; without a label from 0 up all tables are empty.
    """
    member = cut(G.supernodes(labels, 1))
    sizes = member.groupBy("super").agg(F.count(F.lit(1)).alias("size"))
    coarse_links = cut(G.coarsen(links, member))
    comp = cut(components(coarse_links, "si", "sj", sizes.select(F.col("super").alias("node_id"))).withColumnRenamed("node_id", "super"))
    weighed = comp.join(sizes, "super")
    mass = weighed.groupBy("comp").agg(F.sum("size").alias("mass"))
    top = mass.agg(F.min(F.struct((-F.col("mass")).alias("neg"), "comp")).alias("t")).select(F.col("t.comp").alias("comp"))
    index = cut(dense_index(weighed.join(F.broadcast(top), "comp", "left_semi").select("super", "size"), ["super"], "i").select("super", "i", "size"))
    a = index.select(F.col("super").alias("si"), "i")
    b = index.select(F.col("super").alias("sj"), F.col("i").alias("j"))

    def kept(edges: DataFrame) -> DataFrame:
        return lookup(lookup(edges, a, "si"), b, "sj").select("i", "j", "w")

    number = index.select("super", "i")
    found = None
    if counts is not None:
        present = counts.where(F.col("n") >= threshold).select("node_id", "gene", F.lit(1).cast("long").alias("n"))
        found = lookup(G.coarsen_counts(present, member, "node_id", "gene", "n"), number, "super").select("i", "gene", "n")
    centres = lookup(G.centroids(points, member, coords), number, "super").select("i", *coords, "n")
    return CoarseFlow(member, index, kept(coarse_links), kept(G.coarsen(transport, member)), centres, found)
