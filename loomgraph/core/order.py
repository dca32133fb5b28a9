"""Global order without a single-task window.

Rows are range partitioned and sorted inside partitions; only one number per
partition (its row count or sum) is needed to turn local positions into global
ones.  That table has as many rows as there are partitions and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.core.session import cut
from loomgraph.core.skew import lookup

_BITS = 33


def _sorted_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-sorted rows with ``_part`` (slice number) and ``_pos`` (place in it).

    The slices are materialised, so both numbers stay the same for every use.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(placed)
    return placed.select(
        *df.columns,
        F.shiftright("_id", _BITS).cast("int").alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("_pos"),
    )


def _slice_starts(slices: DataFrame, total: Column) -> DataFrame:
    """Sum of ``total`` over all earlier slices, one row per slice."""
    per = slices.groupBy("_part").agg(total.alias("_sum"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number all rows 0,1,2,... in the given order, which must be total."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    slices = _sorted_slices(df, cols)
    starts = _slice_starts(slices, F.count(F.lit(1)))
    return slices.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_pos") + start).cast("long").alias(name)
    )


def group_index(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows 0,1,... inside each group; ``order`` starts with the groups.

    The same as a row number over a window, without putting a group in one task.
    """
    placed = dense_index(df, order, "_place")
    first = placed.groupBy(*groups).agg(F.min("_place").alias("_first"))
    joined = lookup_groups(placed, first, groups)
    return joined.select(*df.columns, (F.col("_place") - F.col("_first")).alias(name))


def running_sums(df: DataFrame, order: Sequence[str | Column], values: dict[str, str]) -> DataFrame:
    """Sums over all rows before the current one in a total order.

    ``values`` maps a value column to the name of its running sum.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    slices = _sorted_slices(df, cols)
    per = slices.groupBy("_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    starts = per.select("_part", *[F.coalesce(F.sum(f"_s_{v}").over(ahead), F.lit(0)).alias(f"_s_{v}") for v in values])
    w = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = slices.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_l_{v}") for v in values])
    return local.join(F.broadcast(starts), "_part").select(
        *df.columns, *[(F.col(f"_s_{v}") + F.col(f"_l_{v}")).alias(name) for v, name in values.items()]
    )


def running_sum(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    return running_sums(df, order, {value: name})


def tie_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per (groups, value): row count ``n_tied`` and rows before it in the group.

    Works on distinct values only, so a value that fills a third of the table is
    one row here.  Groups may be few and large: the order is global over
    (groups, value) and the group's own start is subtracted.
    """
    distinct = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_tied"))
    summed = running_sum(distinct, [*groups, value], "n_tied", "_before")
    if groups:
        first = summed.groupBy(*groups).agg(F.min("_before").alias("_first"), F.sum("n_tied").alias("n_group"))
        summed = lookup_groups(summed, first, groups)
        before = F.col("_before") - F.col("_first")
    else:
        total = summed.agg(F.sum("n_tied").alias("n_group"))
        summed = summed.join(F.broadcast(total))
        before = F.col("_before")
    return summed.select(*groups, value, "n_tied", before.cast("long").alias("n_before"), "n_group")


def lookup_groups(rows: DataFrame, table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Skew-safe lookup on one or several key columns."""
    if len(groups) == 1:
        return lookup(rows, table, groups[0])
    key = F.to_json(F.struct(*groups))
    return lookup(rows.withColumn("_key", key), table.withColumn("_key", key).drop(*groups), "_key").drop("_key")


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks 1..n inside each group, equal values sharing their mean rank."""
    ranks = tie_ranks(df, groups, value).withColumn(name, F.col("n_before") + (F.col("n_tied") + 1) / 2.0)
    table = ranks.select(*groups, value, name, "n_group")
    keys = [*groups, value]
    return lookup_groups(df, table, keys)
