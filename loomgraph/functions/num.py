"""Numeric Column builders: vectors, odds, tails."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.least(_c(x), F.lit(hi)), F.lit(lo))


def logit(x: Column | str, eps: float = 1e-4) -> Column:
    """log(p/(1-p)) of a fraction kept inside [eps, 1-eps]."""
    p = clip(_c(x), eps, 1.0 - eps)
    return F.log(p / (1 - p))


def log_odds(a: Column, n_a: Column, b: Column, n_b: Column) -> tuple[Column, Column]:
    """Log odds ratio and its variance with half a count added to each cell."""
    w, x = a + 0.5, n_a - a + 0.5
    y, z = b + 0.5, n_b - b + 0.5
    return F.log((w * z) / (x * y)), 1 / w + 1 / x + 1 / y + 1 / z


def sq_dist(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for p, q in zip(a, b):
        total = total + (p - q) * (p - q)
    return total


def huber(x: Column, delta: float) -> Column:
    size = F.abs(x)
    return F.when(size <= delta, 0.5 * x * x).otherwise(delta * (size - 0.5 * delta))


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided standard normal tail probability."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v is not None and v == v else None).astype("float64")


@pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse of the standard normal distribution."""
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    return p.map(lambda v: inv(v) if v is not None and 0.0 < v < 1.0 else None).astype("float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if t != t or df <= 0:
        return math.nan
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a or b is None else student_tail(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")
