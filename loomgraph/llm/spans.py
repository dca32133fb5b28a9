"""Positions of regular-expression matches with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """``kind`` is found by ``pattern``; ``group`` is the part that ``test`` accepts or drops."""

    kind: str
    pattern: str
    group: int = 0
    test: str = "true"  # SQL over g, the text of the group
    version: str = "1"


def matches(text: str, rule: Rule, number: int) -> Column:
    """Array of every match in order: kind number, place, length of the gap before, length, kept or not.

    Splitting by the pattern gives the gaps between the very matches that
    extraction gives, so lengths alone tell all positions, in code points.
    """
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g"),
        F.split(text, rule.pattern, -1).alias("gap"),
    )
    return F.transform(
        F.filter(pieces, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(number).alias("k"),
            i.alias("i"),
            F.char_length(x["gap"]).alias("gap"),
            x["m"].alias("m"),
            x["g"].alias("g"),
        ),
    )


def located(blobs: DataFrame, key: str, text: str, rules: Sequence[Rule], carry: Sequence[str] = ()) -> DataFrame:
    """One row per kept match of ``blobs``: key, k (number of the rule), start, end, m, g.

    Start and end are code points, end exclusive.  Only running sums over the
    matches of one text and rule are needed; texts without a match give no row.
    """
    some = F.lit(False)
    for rule in rules:
        some = some | F.col(text).rlike(rule.pattern)
    hit = blobs.where(some)
    parts = F.concat(*[matches(text, r, n) for n, r in enumerate(rules)])
    rows = hit.select(key, *carry, F.inline(parts))
    order = Window.partitionBy(key, "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("m")).over(order))
    good = F.lit(False)
    for n, rule in enumerate(rules):
        good = good | ((F.col("k") == n) & F.expr(rule.test))
    return rows.where(good).select(
        key, *carry, "k", "i", (F.col("end") - F.char_length("m")).alias("start"), "end", "m", "g"
    )
