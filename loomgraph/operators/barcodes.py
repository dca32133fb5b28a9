"""Unique barcodes, one-mismatch neighbours and directional clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.core.order import dense_index
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.functions.seq import BASES, del_at, max_base_fraction


def unique_sequences(stacked: DataFrame, seq: str = "seq") -> DataFrame:
    """Distinct sequences, numbered in lexicographic order, with read counts."""
    counts = stacked.groupBy(F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("n_reads"))
    return dense_index(counts, ["seq"], "seq_idx").select("seq", "seq_idx", "n_reads")


def mismatch_members(uniq: DataFrame, length: int) -> DataFrame:
    """Members of groups that agree everywhere but at one position.

    The key is (position, rest of the sequence).  Sequences in a group differ in
    one letter only, so a group has no more members than the alphabet has
    letters, whatever the data.  Groups of one are dropped.
    """
    at = F.explode(F.sequence(F.lit(1), F.lit(length))).alias("pos")
    keyed = uniq.select("seq_idx", "n_reads", "seq", at)
    keyed = keyed.select("pos", del_at("seq", F.col("pos")).alias("rest"), "seq_idx", "n_reads")
    w = Window.partitionBy("pos", "rest")
    return keyed.withColumn("n_members", F.count(F.lit(1)).over(w)).where("n_members > 1")


def number_groups(uniq: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """Group numbers: position block plus place of the key in its sorted block.

    Single groups take part in the numbering, so it is done over all keys.
    """
    at = F.explode(F.sequence(F.lit(1), F.lit(length))).alias("pos")
    keys = uniq.select("seq", at).select("pos", del_at("seq", F.col("pos")).alias("rest")).distinct()
    placed = dense_index(keys, ["pos", "rest"], "place")
    first = placed.groupBy("pos").agg(F.min("place").alias("first"))
    total = uniq.agg(F.count(F.lit(1)).alias("n_seq"))
    numbered = (
        placed.join(F.broadcast(first), "pos")  # one row per barcode position
        .join(F.broadcast(total))  # a single row
        .select("pos", "rest", ((F.col("pos") - 1) * F.col("n_seq") + F.col("place") - F.col("first")).alias("eq_grp"))
    )
    return members.join(numbered, ["pos", "rest"])


def reads_below(members: DataFrame, group: list[str]) -> DataFrame:
    """Reads of the lower members of a group, before each member.

    Members are ordered by reads; equal reads by the index written as text with
    a trailing comma, which puts 10 before 9 and 1 before 10.
    """
    as_text = F.concat(F.col("seq_idx").cast("string"), F.lit(","))
    w = Window.partitionBy(*group).orderBy("n_reads", as_text).rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("cumul_reads", F.coalesce(F.sum("n_reads").over(w), F.lit(0)))


def rnd_scores(members: DataFrame, group: list[str]) -> DataFrame:
    """Own reads plus the reads below, summed over all groups of the sequence."""
    below = reads_below(members, group)
    return below.groupBy("seq_idx").agg((F.max("n_reads") + F.sum("cumul_reads")).alias("rnd"))


def neighbour_pairs(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Ordered pairs (upper, lower) inside groups, each with the group's number.

    Two sequences share at most one group and a group has at most one member
    per letter, so a sequence has at most (letters - 1) x length pairs.
    """
    m = members.select("eq_grp", "seq_idx").join(scores, "seq_idx")
    up = m.select("eq_grp", F.col("seq_idx").alias("upper"), F.col("rnd").alias("upper_rnd"))
    lo = m.select("eq_grp", F.col("seq_idx").alias("lower"), F.col("rnd").alias("lower_rnd"))
    before = (F.col("upper_rnd") > F.col("lower_rnd")) | ((F.col("upper_rnd") == F.col("lower_rnd")) & (F.col("upper") < F.col("lower")))
    return up.join(lo, "eq_grp").where(before)


def directional_clusters(uniq: DataFrame, length: int, max_rounds: int = 200) -> tuple[DataFrame, int]:
    """(seq_idx, clust) for every sequence, and the number of rounds used.

    In each round every sequence looks at the members ranked above it in its
    groups and takes over the cluster with the strictly larger score; among
    equal scores the group number (as text) and then the rank decide.  All
    sequences move at once; the loop ends when none moves.
    """
    members = number_groups(uniq, mismatch_members(uniq, length), length)
    members = cut(members.select("pos", "rest", "eq_grp", "seq_idx", "n_reads"))
    scores = cut(rnd_scores(members, ["eq_grp"]))
    pairs = cut(
        neighbour_pairs(members, scores).select(
            "upper", "lower", F.col("eq_grp").cast("string").alias("grp_text"), "upper_rnd"
        )
    )
    state = scores.select("seq_idx", F.col("seq_idx").alias("clust"), F.col("rnd").alias("clust_rnd"))
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        offer = F.struct(
            (-F.col("clust_rnd")).alias("neg"), "grp_text", (-F.col("upper_rnd")).alias("neg_rank"), "upper", "clust", "clust_rnd"
        )
        best = (
            pairs.join(state.withColumnRenamed("seq_idx", "upper"), "upper")
            .groupBy(F.col("lower").alias("seq_idx"))
            .agg(F.min(offer).alias("best"))
        )
        moved = F.coalesce(F.col("best.clust_rnd") > F.col("clust_rnd"), F.lit(False))
        step = state.join(best, "seq_idx", "left").select(
            "seq_idx",
            F.when(moved, F.col("best.clust")).otherwise(F.col("clust")).alias("clust"),
            F.when(moved, F.col("best.clust_rnd")).otherwise(F.col("clust_rnd")).alias("clust_rnd"),
            moved.alias("moved"),
        )
        step = cut(step)
        changed = step.where("moved").limit(1).count()
        state = step.drop("moved")
        if not changed:
            break
    else:
        raise RuntimeError(f"clusters still move after {max_rounds} rounds")
    out = uniq.select("seq_idx").join(state, "seq_idx", "left")
    return out.select("seq_idx", F.coalesce("clust", "seq_idx").alias("clust")), rounds


def read_clusters(stacked: DataFrame, uniq: DataFrame, clusters: DataFrame, max_fraction: float = 0.75) -> DataFrame:
    """Cluster of each read; -1 when the read's own barcode is low-complexity."""
    table = uniq.select("seq", "seq_idx", (max_base_fraction("seq") >= max_fraction).alias("low")).join(clusters, "seq_idx")
    table = table.select("seq", F.when(F.col("low"), -1).otherwise(F.col("clust")).cast("long").alias("clust"))
    return lookup(stacked, table, "seq").select("read_id", "clust")


def base_composition(uniq: DataFrame) -> DataFrame:
    """Read-weighted base counts per position."""
    chars = uniq.select(F.posexplode(F.split("seq", "")).alias("pos", "base"), "n_reads")
    sums = [F.sum(F.when(F.col("base") == b, F.col("n_reads")).otherwise(0)).alias(f"n_{b.lower()}") for b in BASES]
    return chars.groupBy(F.col("pos").cast("long").alias("pos")).agg(*sums)


def collision_probability(composition: DataFrame) -> DataFrame:
    """Chance that two random barcodes lie within one mismatch.

    Reads one row per barcode position.  With e the probability of agreement at
    a position, it is prod(e) * (1 + sum((1 - e) / e)).
    """
    total = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    e = sum(((F.col(c) / total) * (F.col(c) / total) for c in ("n_a", "n_c", "n_g", "n_t")), F.lit(0.0))
    return composition.withColumn("e", e).agg(
        (F.exp(F.sum(F.log("e"))) * (1 + F.sum((1 - F.col("e")) / F.col("e")))).alias("p1")
    )


def critical_count(p1: float, most: int = 10_000_000, step: int = 1 << 16) -> int:
    """Largest n with prod over k=1..n of (1 - k * p1) above one half; an error beyond ``most``.

    The product falls, so logarithms are added a block at a time.
    """
    if not 0.0 < p1 < 1.0:
        raise ValueError("the collision probability must lie between 0 and 1")
    total, first = 0.0, 1
    while first <= most:
        k = np.arange(first, first + step, dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = total + np.cumsum(np.log1p(-np.minimum(k * p1, 1.0)))
        over = np.flatnonzero(left <= np.log(0.5))
        if len(over) and first + int(over[0]) - 1 <= most:
            return first + int(over[0]) - 1
        total, first = float(left[-1]), first + step
    raise ValueError(f"more than {most} barcodes are needed")
