"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with fewer rows than this is handled by one task without trouble.
HOT_ROWS = 1_000_000
# Only the heaviest keys are split off, so what is broadcast is bounded.
MAX_HOT = 2_048
# Estimated input below this cannot hold a key that overloads a task.
SMALL_BYTES = 64 << 20


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS, top: int = MAX_HOT) -> list:
    """The at most ``top`` heaviest key values with ``rows`` rows or more."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= rows)
    return [r[0] for r in counts.orderBy(F.desc("count"), key).limit(top).collect()]


def known_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """True when the optimizer's size estimate alone rules out a heavy key (no job)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) < limit
    except Exception:  # noqa: BLE001 - no estimate, so look at the data
        return False


def _hot_of(rows: DataFrame, key: str) -> list:
    """Hot keys of ``rows``, found on the table a chain of lookups started from.

    A lookup never multiplies rows, so the first table's counts hold for the
    whole chain and one job serves it.
    """
    base = rows.__dict__.get("_lookup_base", rows)
    source = base if key in base.columns else rows
    memo = source.__dict__.setdefault("_hot_keys", {})
    if key not in memo:
        memo[key] = [] if known_small(source) else hot_keys(source, key)
    return memo[key]


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    hot: Sequence | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` (at most one row per key) on ``key``.

    Rows of hot keys meet a broadcast of those keys' table rows (at most
    ``MAX_HOT`` of them), all others meet in a shuffle join.  The result is the
    plain join.  ``hot`` may be given when it is known, as inside a loop.
    """
    if hot is None:
        hot = _hot_of(rows, key)
    if not hot:
        out = rows.join(table, key, how)
    else:
        is_hot = F.col(key).isin(list(hot))
        left_hot = rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how)
        cold = F.coalesce(~is_hot, F.lit(True))
        left_cold = rows.where(cold).join(table.where(~is_hot), key, how)
        out = left_hot.unionByName(left_cold)
    out.__dict__["_lookup_base"] = rows.__dict__.get("_lookup_base", rows)
    return out
