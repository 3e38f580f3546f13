"""Means, roots of mean squares and shares that no finite values make overflow or vanish, as plain sums in one aggregation.

Values are added up by magnitude, large ones scaled down and small ones scaled up by a power of two, which changes no
digit; the sums are mergeable like any other. Where no value is extreme the result is that of the plain formula.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of fewer than 2^70 values below LARGE, and of their squares below LARGE_SQUARE, are finite.
LARGE, LARGE_SQUARE, SMALL_SQUARE = 2.0**900, 2.0**470, 2.0**-450
SHIFT = 2.0**-600


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def safe_total(c: Column) -> Column:
    """A sum as a struct: of values below LARGE, and of the others times SHIFT."""
    large = F.abs(c) >= LARGE
    return F.struct(_sum(F.when(~large, c)).alias("plain"), _sum(F.when(large, c * SHIFT)).alias("scaled"), F.count_if(large).alias("large"))


def safe_mean(c: Column) -> Column:
    """NULL without values."""
    large = F.abs(c) >= LARGE
    plain, scaled, n = F.sum(F.when(~large, c)), F.sum(F.when(large, c * SHIFT)), F.count(c)
    return F.when(scaled.isNull(), F.avg(F.when(~large, c))).otherwise((scaled + F.coalesce(plain, F.lit(0.0)) * SHIFT) / n / SHIFT)


def safe_rms(c: Column) -> Column:
    """NULL without values."""
    a, n = F.abs(c), F.count(c)
    low, high = c / SHIFT, c * SHIFT
    large = F.sum(F.when(a >= LARGE_SQUARE, high * high))
    middle = F.sum(F.when((a < LARGE_SQUARE) & (a >= SMALL_SQUARE), c * c))
    small = F.sum(F.when(a < SMALL_SQUARE, low * low))
    some = F.coalesce(middle, F.lit(0.0))
    # a small value's square is beyond the last digit of a middle one's
    return F.when(large.isNotNull(), F.sqrt((large + some * SHIFT * SHIFT) / n) / SHIFT).when(middle.isNotNull(), F.sqrt(middle / n)).otherwise(F.sqrt(small / n) * SHIFT)


def share_of(part: Column, total: Column) -> Column:
    """Percent that one safe_total is of another; 0 where the whole is 0."""
    extreme = total["large"] > 0
    whole = lambda t: t["scaled"] + t["plain"] * SHIFT
    return F.when(extreme, whole(part) / whole(total) * 100).when(total["plain"] > 0, part["plain"] / total["plain"] * 100).otherwise(0.0)


def piece_between(v: Column, low: Column, high: Column, pieces: int) -> Column:
    """Which of the equal pieces from low to high (low < high) v is in, from 0: never falls as v grows, whatever the span."""
    span = high - low
    part = F.when(F.abs(span) < float("inf"), F.try_divide(v - low, span)).otherwise(F.try_divide(v / 2 - low / 2, high / 2 - low / 2))
    return F.least(F.floor(part * pieces), F.lit(pieces - 1)).cast("int")
