"""From raw mates to stacked barcodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.core.order import dense_index
from loomgraph.functions.seq import mean_phred, revcomp
from loomgraph.operators.seqform import Form, Slot, amplicon, barcodes, classify


def quality_filter(raw: DataFrame, min_mean: float = 30.0) -> DataFrame:
    """Keep reads whose arithmetic mean quality reaches ``min_mean``."""
    return raw.where(mean_phred("qual") >= min_mean)


def join_mates(raw: DataFrame, min_mean: float = 30.0) -> DataFrame:
    """One row per read number for which both mates passed the filter."""
    good = quality_filter(raw, min_mean)
    fwd = good.where(F.col("mate") == 1).select("read_no", F.col("name"), F.col("seq").alias("read1"))
    rev = good.where(F.col("mate") == 2).select("read_no", F.col("seq").alias("read2"))
    return fwd.join(rev, "read_no")


def single_end(raw: DataFrame, min_mean: float = 30.0) -> DataFrame:
    """Only forward reads exist: the other mate is the empty string."""
    return quality_filter(raw, min_mean).select("read_no", "name", F.col("seq").alias("read1"), F.lit("").alias("read2"))


def parse_reads(pairs: DataFrame, for_forms: Sequence[Form], rev_forms: Sequence[Form]) -> DataFrame:
    """Form indices, barcode arrays and amplicons; unmatched mates get -1."""
    r1, r2 = F.col("read1"), F.col("read2")
    indexed = pairs.withColumn("for_index", classify(r1, for_forms)).withColumn("rev_index", classify(r2, rev_forms))
    return indexed.select(
        F.col("read_no").alias("read_id"),
        "for_index",
        "rev_index",
        barcodes(r1, for_forms, F.col("for_index")).alias("for_uxis"),
        barcodes(r2, rev_forms, F.col("rev_index")).alias("rev_uxis"),
        amplicon(r1, for_forms, F.col("for_index")).alias("for_amp"),
        amplicon(r2, rev_forms, F.col("rev_index")).alias("rev_amp"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where((F.col("for_index") >= 0) & (F.col("rev_index") >= 0))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where((F.col("for_index") < 0) | (F.col("rev_index") < 0))


def form_counts(parsed: DataFrame) -> DataFrame:
    """Reads per form pair; all rejected reads are counted under (-1, -1)."""
    bad = (F.col("for_index") < 0) | (F.col("rev_index") < 0)
    return parsed.groupBy(
        F.when(bad, -1).otherwise(F.col("for_index")).alias("for_index"),
        F.when(bad, -1).otherwise(F.col("rev_index")).alias("rev_index"),
    ).agg(F.count(F.lit(1)).alias("n"))


def restack(parsed: DataFrame, stacks: Mapping[int, Sequence[Slot]]) -> DataFrame:
    """Long table (read_id, k, for_index, rev_index, seq) of stacked barcodes.

    Positions count through the forward barcodes and then the reverse ones.  All
    stacks are evaluated in one pass over the reads.
    """
    ok = accepted(parsed).withColumn("_all", F.concat("for_uxis", "rev_uxis"))
    entries = []
    for k, slots in stacks.items():
        value = None
        for s in slots:
            cond = F.lit(True)
            if s.for_index is not None:
                cond = cond & (F.col("for_index") == s.for_index)
            if s.rev_index is not None:
                cond = cond & (F.col("rev_index") == s.rev_index)
            piece = F.get(F.col("_all"), F.lit(s.position))
            piece = revcomp(piece) if s.revcomp else piece
            value = F.when(cond, piece) if value is None else value.when(cond, piece)
        entries.append(F.struct(F.lit(k).alias("k"), value.alias("seq")))
    long = ok.select("read_id", "for_index", "rev_index", F.explode(F.array(*entries)).alias("e"))
    return long.select("read_id", "e.k", "for_index", "rev_index", "e.seq").where(F.col("seq").isNotNull())


def length_report(stacked: DataFrame) -> DataFrame:
    """Shortest and longest barcode per stack; they must agree."""
    return stacked.groupBy("k").agg(
        F.min(F.length("seq")).cast("long").alias("min_len"), F.max(F.length("seq")).cast("long").alias("max_len")
    )


def require_uniform(stacked: DataFrame) -> None:
    """Raise when a stack mixes barcode lengths (the report has one row per stack)."""
    bad = length_report(stacked).where("min_len <> max_len").collect()
    if bad:
        raise ValueError(f"barcodes of unequal length: {[r.asDict() for r in bad]}")


def subsample_depths(total: int, base: int = 100_000, fewest: int = 5) -> list[int]:
    """Doubling depths below ``total``; with too few of them, also halvings of the base."""
    depths, d = [], base
    while d < total:
        depths.append(d)
        d *= 2
    d = base // 2
    while len(depths) < fewest and d >= 1:
        if d < total:
            depths.append(d)
        d //= 2
    return sorted(depths)


def subsample(rows: DataFrame, key: str, depth: int, seed: int = 0) -> DataFrame:
    """A uniform sample of exactly ``depth`` rows, nested in that of a larger depth.

    Rows are ranked by a hash of (key, seed): the draw is the same on every
    attempt, and allocation over read forms is multivariate hypergeometric.
    """
    order = F.xxhash64(F.col(key), F.lit(seed))
    ranked = dense_index(rows.withColumn("_h", order), ["_h", key], "sample_no")
    return ranked.where(F.col("sample_no") < depth).drop("_h")


def rarefy(counts: DataFrame, row: str, feature: str, n: str, depth: int, seed: int = 0) -> DataFrame:
    """Draw exactly ``depth`` events per row without replacement.

    Rows with fewer events are left out.  Events are expanded to one row each
    and ranked by a hash; a row's events are spread over tasks by salt first, so
    each task keeps only its ``depth`` smallest hashes before the final ranking.
    """
    events = counts.where(F.col(n) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
    events = events.withColumn("_h", F.xxhash64(F.col(row), F.col(feature), F.col("_copy"), F.lit(seed)))
    events = events.withColumn("_salt", F.pmod(F.col("_h"), F.lit(64)))
    part = Window.partitionBy(row, "_salt").orderBy("_h", feature, "_copy")
    kept = events.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= depth)
    w = Window.partitionBy(row).orderBy("_h", feature, "_copy")
    kept = kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= depth)
    enough = counts.groupBy(row).agg(F.sum(n).alias("_t")).where(F.col("_t") >= depth).select(row)
    out = kept.groupBy(row, feature).agg(F.count(F.lit(1)).alias(n))
    return out.join(enough, row, "left_semi")
