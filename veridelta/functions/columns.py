"""Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Spark reads '1d' and '0x10f' as numbers in a cast from text; only these forms count.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


#: A time of day, then Z, an offset or a zone's name.
_ZONED = r"\d:\d{2}(:\d{2}(\.\d+)?)?\s*([Zz]|[+-]\d{1,2}(:?\d{2})?|UTC|GMT|[A-Z][A-Za-z_]+/[A-Za-z_/]+)\s*$"
#: A date, or a date and a time of day, alone.
_LOCAL = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d*)?)?)?\s*$"


def text_time_kinds(name: str) -> tuple[Column, Column]:
    """Whether a text names a zone of its own, and whether it is a local time: a column should hold one kind."""
    c = F.col(f"`{name}`")
    return c.rlike(_ZONED), c.rlike(_LOCAL)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def num(name: str, kind: DataType) -> Column:
    """A column as a finite double; anything else is NULL. No cast stands in the way of a pushed filter where the type is double already."""
    c = F.col(f"`{name}`")
    if isinstance(kind, StringType):
        return finite(F.when(c.rlike(_NUMBER), c.try_cast("double")))
    return finite(c.cast("double")) if isinstance(kind, NumericType) else F.lit(None).cast("double") if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else finite(c.try_cast("double"))


def utc_time(name: str, kind: DataType, zone: str) -> Column:
    """A column as a UTC instant. Local times that a clock change skips or repeats are NULL. A text that names its own
    zone or offset is that instant, one without is a local time; a text with anything else behind the time, such as an
    abbreviation, which may mean several zones, is NULL."""
    c = F.col(f"`{name}`")
    if isinstance(kind, TimestampType):
        return c
    if isinstance(kind, StringType):
        return F.when(c.rlike(_ZONED), c.try_cast("timestamp")).when(c.rlike(_LOCAL), _from_local(c.try_cast("timestamp_ntz"), zone))
    return _from_local(c.cast("timestamp_ntz"), zone)


def _from_local(local: Column, zone: str) -> Column:
    if zone == "UTC":
        return local.cast("timestamp")
    wall = local.cast("timestamp")  # the session runs in UTC
    at = F.to_utc_timestamp(wall, zone)
    again = [F.from_utc_timestamp(at + F.expr(f"INTERVAL {m} MINUTES"), zone) == wall for m in (-60, -30, 30, 60)]
    repeated = again[0] | again[1] | again[2] | again[3]
    return F.when((F.from_utc_timestamp(at, zone) == wall) & ~repeated, at)


def local_time(at: Column, zone: str) -> Column:
    return at if zone == "UTC" else F.from_utc_timestamp(at, zone)


def floor_bin(at: Column, width: int) -> Column:
    """Number of the epoch-anchored bin of width microseconds that an instant is in."""
    return F.floor(F.unix_micros(at) / F.lit(width)).cast("long") if width <= 2**52 else F.lit(0).cast("long")


def _edge(x: float) -> str:
    return "inf" if x == math.inf else "-inf" if x == -math.inf else repr(float(x))


def bin_names(edges: tuple, right: bool) -> list[str]:
    """The names of unlabelled bins. The lowest of right-closed bins takes its lower edge in and shows it a thousandth lower."""
    if not right:
        return [f"[{_edge(a)}, {_edge(b)})" for a, b in zip(edges, edges[1:])]
    low = [_edge(round(edges[0] - 0.001, 3)) if math.isfinite(edges[0]) else _edge(edges[0]), *map(_edge, edges[1:])]
    return [f"({a}, {b}]" for a, b in zip(low, low[1:])]


def apart(name: str, taken: list[str] | set[str]) -> str:
    while name in taken:
        name += "*"
    return name


def bin_label(value: Column, edges: tuple, labels: tuple | None, right: bool) -> tuple[Column, Column]:
    """(label, order) of a numeric value."""
    names = list(labels) if labels is not None else bin_names(edges, right)
    outside, missing = apart("(outside bins)", names), apart("(missing/nonfinite)", names)
    label, order = F.when(value.isNull(), missing), F.when(value.isNull(), len(names) + 1)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = ((value > a) | (F.lit(i == 0) & (value == a))) & (value <= b) if right else (value >= a) & (value < b)
        label, order = label.when(inside, names[i]), order.when(inside, i)
    return label.otherwise(outside), order.otherwise(len(names)).cast("int")


def rounded_correlation(n: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """NULL for fewer than three pairs or a constant side; within -1 and 1."""
    r = F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))
    return F.when((n >= 3) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
