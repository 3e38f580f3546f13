"""Student's t: two-sided p-values and quantiles, by the regularised incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 20_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def quantile(alpha: float, df: float) -> float:
    """The t with a two-sided tail of alpha."""
    low, high = 0.0, 1.0
    while two_sided(high, df) > alpha:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if two_sided(mid, df) > alpha else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def _p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([two_sided(abs(a), b) if not (np.isnan(a) or np.isnan(b)) else None for a, b in zip(t, df, strict=True)], dtype=float)


def p_value(t: Column, df: Column) -> Column:
    """For aggregated tables: a row per tested cell."""
    return _p(t.cast("double"), df.cast("double"))


def t_quantile(alpha: float, df: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def q(n: pd.Series) -> pd.Series:
        known = {x: quantile(alpha, x) for x in n.dropna().unique()}
        return n.map(known).astype(float)

    return q(df.cast("double"))
