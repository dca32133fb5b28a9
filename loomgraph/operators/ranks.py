"""Ranks, rescaling, false discovery, apportionment, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.core.order import _sorted_slices, average_ranks, dense_index, tie_ranks, lookup_groups
from loomgraph.functions.num import normal_quantile

EPS = 1e-12


def long_columns(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, field, value) rows of several numeric columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(key, F.inline(entries))


def rank_scores(values: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Average ranks per field, centred and scaled to unit length.

    The scale is that of n distinct ranks: sqrt(12 / (n (n^2 - 1))).
    """
    r = average_ranks(values, [field], value, "rank")
    n = F.col("n_group").cast("double")
    scale = F.sqrt(12.0 / (n * (n * n - 1)))
    return r.withColumn("score", F.when(n > 1, scale * (F.col("rank") - (n + 1) / 2)).otherwise(0.0))


def binned_ranks(df: DataFrame, value: str, bins: int = 2_048, accuracy: int = 65_536) -> DataFrame:
    """Mid-ranks of quantile bins, for tables too large for exact ranks.

    The driver holds the bin edges only (at most ``bins`` numbers).
    """
    from pyspark.ml.feature import Bucketizer

    cuts = [i / bins for i in range(1, bins)]
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(c) for c in cuts]), F.lit(accuracy)).alias("e")).first()["e"] or []
    edges = sorted(set(float(e) for e in edges))
    if not edges:
        placed = df.withColumn("bin", F.lit(0.0))
    else:
        placed = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=value, outputCol="bin").transform(df)
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))  # at most `bins` rows
    before = F.coalesce(F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mid = counts.select("bin", (before + (F.col("c") + 1) / 2.0).alias("rank"))
    return placed.join(F.broadcast(mid), "bin").drop("bin")


def masked_ranks(values: DataFrame, field: str, value: str, support: str, neutral: float = 0.5) -> DataFrame:
    """Average rank over largest rank where there is support, else neutral."""
    inside = values.where(F.col(support) > EPS)
    ranks = tie_ranks(inside, [field], value).withColumn("r", F.col("n_before") + (F.col("n_tied") + 1) / 2.0)
    top = ranks.groupBy(field).agg(F.max("r").alias("m"))
    table = lookup_groups(ranks.select(field, value, "r"), top, [field]).select(field, value, (F.col("r") / F.col("m")).alias("out"))
    placed = lookup_groups(inside, table, [field, value])
    rest = values.where(~(F.col(support) > EPS) | F.col(support).isNull()).withColumn("out", F.lit(neutral))
    return placed.unionByName(rest)


def unit_rescale(values: DataFrame, field: str, value: str, support: str, neutral: float = 0.5) -> DataFrame:
    """Min-max rescaling per field over supported rows; constants become neutral."""
    ok = F.col(support) > EPS
    lim = values.groupBy(field).agg(F.min(F.when(ok, F.col(value))).alias("_lo"), F.max(F.when(ok, F.col(value))).alias("_hi"))
    x = lookup_groups(values, lim, [field])
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return x.withColumn("out", F.when(ok & (F.col("_hi") > F.col("_lo")), scaled).otherwise(neutral)).drop("_lo", "_hi")


def rank_rescale(values: DataFrame, field: str, value: str, mask: Column, neutral: float = 0.5) -> DataFrame:
    """(rank - lowest) / (highest - lowest) over the mask, else neutral."""
    inside = values.where(mask & F.col(value).isNotNull())
    r = tie_ranks(inside, [field], value).withColumn("r", F.col("n_before") + (F.col("n_tied") + 1) / 2.0)
    lim = r.groupBy(field).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    table = lookup_groups(r.select(field, value, "r"), lim, [field])
    table = table.select(field, value, F.when(F.col("hi") > F.col("lo"), (F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(neutral).alias("out"))
    rest = values.where(~F.coalesce(mask & F.col(value).isNotNull(), F.lit(False))).withColumn("out", F.lit(neutral))
    return lookup_groups(inside, table, [field, value]).unionByName(rest)


def rankit(values: DataFrame, field: str, value: str) -> DataFrame:
    """Normal scores of average ranks."""
    r = average_ranks(values.where(F.col(value).isNotNull()), [field], value, "rank")
    p = (F.col("rank") - 0.5) / F.col("n_group")
    return r.withColumn("out", normal_quantile(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))))


def bh_fdr(tests: DataFrame, p: str, key: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg: running minimum of p m / rank from the largest p down.

    The order is global over range-sorted slices; between slices only one
    minimum per slice travels.  NULL and NaN stay out and get NULL.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    valid = dense_index(tests.where(ok), [F.col(p), F.col(key)], "_r")
    m = valid.agg(F.count(F.lit(1)).alias("_m"))
    raw = valid.join(F.broadcast(m)).withColumn("_q", F.col(p) * F.col("_m") / (F.col("_r") + 1)).drop("_m")
    slices = _sorted_slices(raw, [F.desc("_r")])
    per = slices.groupBy("_part").agg(F.min("_q").alias("_s"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    starts = per.select("_part", F.min("_s").over(ahead).alias("_before"))
    w = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = slices.withColumn("_l", F.min("_q").over(w)).join(F.broadcast(starts), "_part")
    out = local.select(*tests.columns, F.least(F.col("_l"), F.col("_before"), F.lit(1.0)).alias(name))
    return out.unionByName(tests.where(~ok).withColumn(name, F.lit(None).cast("double")))


def largest_remainder(mass: DataFrame, key: str, value: str, target: int) -> DataFrame:
    """Integer shares that add up to ``target``: floors plus the largest fractions.

    Negative, missing and NaN masses count as 0; without mass all share alike.
    Ties go to the smaller key.
    """
    clean = F.when(F.col(value).isNull() | F.isnan(F.col(value).cast("double")), 0.0).otherwise(F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    x = mass.select(key, clean.alias("_m"))
    tot = x.agg(F.sum("_m").alias("_t"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_t") > EPS, F.col("_m") / F.col("_t")).otherwise(1.0 / F.col("_n"))
    e = x.join(F.broadcast(tot)).select(key, (share * target).alias("expected")).withColumn("whole", F.floor("expected"))
    e = dense_index(e.withColumn("frac", F.col("expected") - F.col("whole")), [F.desc("frac"), F.col(key)], "_place")
    left = e.agg((F.lit(target) - F.sum("whole")).alias("_left"))
    return e.join(F.broadcast(left)).select(key, "expected", (F.col("whole") + (F.col("_place") < F.col("_left")).cast("long")).alias("capacity"))


def folds(keys: DataFrame, key: str, n: int, seed: int = 0, fold: int = 0) -> DataFrame:
    """A repeatable random split into ``n`` folds of equal size."""
    h = F.xxhash64(F.col(key), F.lit(seed + fold * 1_000_003))
    return dense_index(keys.withColumn("_h", h), ["_h", key], "_p").select(*keys.columns, (F.col("_p") % n).cast("int").alias("fold"))


def stratified_selection(rows: DataFrame, score: str, key: str, most: int) -> DataFrame:
    """High, low and evenly spaced middle rows of a descending order.

    A third each; everything is kept when there are no more than ``most`` rows.
    """
    placed = dense_index(rows, [F.desc(score), F.col(key)], "place")
    n = placed.count()
    if most <= 0 or n <= most:
        return placed.withColumn("selection", F.lit("all_eligible"))
    high = low = most // 3
    middle = most - high - low
    pool = n - high - low
    picks = sorted({high + int(round(i * (pool - 1) / max(1, middle - 1))) for i in range(min(middle, pool))}) if pool > 0 else []
    label = F.when(F.col("place") < high, "external_high").when(F.col("place") >= n - low, "external_low").otherwise("middle_stratified")
    chosen = placed.sparkSession.createDataFrame([(p,) for p in picks], "place long")  # at most `most` numbers
    mid = placed.join(F.broadcast(chosen), "place", "left_semi")
    ends = placed.where((F.col("place") < high) | (F.col("place") >= n - low))
    return ends.unionByName(mid.select(*ends.columns)).withColumn("selection", label)
