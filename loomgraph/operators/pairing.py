"""UEI pairings, association filtering and the molecule edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.core.session import cut
from loomgraph.core.skew import hot_keys, lookup


def read_triples(read_clusters: DataFrame) -> DataFrame:
    """One row per read with its three cluster numbers, from (read_id, k, clust).

    The three stacks meet in one aggregation on the read id (no join).  Reads
    with a missing or low-complexity (-1) cluster are dropped.
    """
    pick = [F.max(F.when(F.col("k") == k, F.col("clust"))).alias(n) for k, n in ((2, "uei"), (0, "umi0"), (1, "umi1"))]
    t = read_clusters.groupBy("read_id").agg(*pick, F.max("for_index").alias("for_index"), F.max("rev_index").alias("rev_index"))
    return t.where("uei >= 0 AND umi0 >= 0 AND umi1 >= 0")


def pair_counts(triples: DataFrame, merge_formats: bool = False) -> DataFrame:
    """Reads per (UEI, UMI pair, read formats)."""
    keys = ["uei", "umi0", "umi1"] + ([] if merge_formats else ["for_index", "rev_index"])
    return triples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"))


def consensus_pairs(counts: DataFrame) -> DataFrame:
    """The pairing with most reads of each UEI; none if the top is tied.

    Two combinable aggregations instead of a window, so that a UEI with very
    many pairings is reduced on the map side.
    """
    rest = [c for c in counts.columns if c not in ("uei", "n_reads")]
    level = counts.groupBy("uei", "n_reads").agg(F.count(F.lit(1)).alias("ways"), F.min(F.struct(*rest)).alias("pair"))
    top = level.groupBy("uei").agg(F.max(F.struct("n_reads", "ways", "pair")).alias("top"))
    return top.where("top.ways = 1").select("uei", *[F.col(f"top.pair.{c}").alias(c) for c in rest], F.col("top.n_reads").alias("n_reads"))


def consolidate(pairs: DataFrame, uei_type: int = 2) -> DataFrame:
    """Associations: number of UEIs and reads per UMI pair."""
    typed = pairs if "uei_type" in pairs.columns else pairs.withColumn("uei_type", F.lit(uei_type))
    return typed.groupBy("umi0", "umi1").agg(
        F.max("uei_type").alias("uei_type"), F.count(F.lit(1)).alias("n_uei"), F.sum("n_reads").alias("n_reads")
    )


def filter_associations(
    assoc: DataFrame, min_reads: int, min_uei: int, min_uei_per_umi: int, max_rounds: int = 1000
) -> tuple[DataFrame, int]:
    """Fixed point of the association and UMI filters.

    An association's own totals never change, so its test is applied once.  The
    loop removes UMIs of the first side, then of the second, that keep too few
    UEIs.  It works on consolidated rows and on the failing UMIs only; those
    have few UEIs each, so no round moves more than it must.
    """
    kept = cut(assoc.where((F.col("n_reads") >= min_reads) & (F.col("n_uei") >= min_uei)))
    hot = {side: hot_keys(kept, side) for side in ("umi0", "umi1")}
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        before = kept.count()
        step = kept
        for side in ("umi0", "umi1"):
            failing = step.groupBy(side).agg(F.sum("n_uei").alias("u")).where(F.col("u") < min_uei_per_umi).select(side)
            step = lookup(step, failing, side, "left_anti", hot[side])
        kept = cut(step)
        if kept.count() == before:
            break
    else:
        raise RuntimeError(f"associations still fall after {max_rounds} rounds")
    return kept, rounds


def endpoint_labelled(edges: DataFrame, labelled0: DataFrame, labelled1: DataFrame) -> DataFrame:
    """Edges with a label on at least one endpoint."""
    a = labelled0.select(F.col("node_id").alias("umi0"), F.lit(True).alias("l0")).distinct()
    b = labelled1.select(F.col("node_id").alias("umi1"), F.lit(True).alias("l1")).distinct()
    both = lookup(lookup(edges, a, "umi0", "left"), b, "umi1", "left")
    return both.where(F.coalesce("l0", F.lit(False)) | F.coalesce("l1", F.lit(False))).drop("l0", "l1")


def extra_edges(candidates: DataFrame, group: DataFrame, min_reads: int = 2) -> DataFrame:
    """Weaker associations between UMIs of a finished group that are not yet in it."""
    strong = candidates.groupBy("umi0", "umi1").agg(F.sum("n_reads").alias("n_reads")).where(F.col("n_reads") >= min_reads)
    inside = lookup(strong, group.select("umi0").distinct(), "umi0", "left_semi")
    inside = lookup(inside, group.select("umi1").distinct(), "umi1", "left_semi")
    return inside.join(group.select("umi0", "umi1"), ["umi0", "umi1"], "left_anti")


def abundance_histogram(totals: DataFrame, n: str, name: str) -> DataFrame:
    """How many clusters were read once, twice, or more often."""
    return totals.agg(
        F.lit(name).alias("kind"),
        F.count_if(F.col(n) == 1).alias("once"),
        F.count_if(F.col(n) == 2).alias("twice"),
        F.count_if(~F.col(n).isin(1, 2)).alias("more"),
    )
