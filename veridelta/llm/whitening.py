"""Whitening of embeddings: a covariance in double-double, its eigenvectors, and the rows along the first of them.

Components become integers floor(scale * c) + shift; the fit list is each distinct integer vector once, a table in the
shared folder. Counts and sums are exact integers. Every task centres its vectors by the mean in double-double (an error
free subtraction, then the mean's low part) and adds up their outer products in double-double: products by Dekker's
splitting, sums by Knuth's two-sum, in a tree over the rows. A task sends one row of high and low parts for each row of
the matrix's upper half; these are merged in double-double, first by groups of tasks, then altogether. Only the matrix
itself, dimension by dimension numbers, comes to the driver, where LAPACK's syevd (Householder's tridiagonal form, then
divide and conquer) gives the eigenvectors. The covariance of the whitened fit list is measured the same way.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; null and repeated ids
are rows like others; components of the eigenvalue zero, up to the matrix's rounding, are left out, so there are no
rows if all vectors are equal; signs are such that a component's largest entry is positive; a deviation beyond 63 bits
is null; other columns are ignored; an empty table gives no rows; vectors of several lengths and entries of 2^52 or more
raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, stored, vector_block, whole_vector

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Groups of tasks whose matrices are merged first.
MERGES = 64
#: Numbers of one of a task's arrays.
BLOCK = 1 << 17
_HALF = "i int, task int, high array<double>, low array<double>"


def two_sum(a, b):
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a):
    """a as two halves of 26 bits."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def dd_add(ah, al, bh, bl):
    """The sum of two double-doubles."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = fast_two_sum(s, e + t)
    return fast_two_sum(s, e + f)


def fast_two_sum(a, b):
    """two_sum where a is the larger."""
    s = a + b
    return s, b - (s - a)


def dd_total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums over the first axis, in a tree."""
    while len(high) > 1:
        n = len(high) // 2
        h, e = dd_add(high[:n], low[:n], high[n : 2 * n], low[n : 2 * n])
        if len(high) % 2:
            h, e = np.concatenate([h, high[-1:]]), np.concatenate([e, low[-1:]])
        high, low = h, e
    return high[0], low[0]


class OuterProducts:
    """The upper half of the sum of y y' over rows y, high and low parts; dimension by dimension numbers."""

    def __init__(self, dim: int):
        self.high, self.low = np.zeros((dim, dim)), np.zeros((dim, dim))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        dim = high.shape[1]
        step = max(1, BLOCK // dim)
        for at in range(0, len(high), step):
            y, z = high[at : at + step], low[at : at + step]
            a, b = split(y)
            for i in range(dim):
                p = y[:, i : i + 1] * y[:, i:]
                e = ((a[:, i : i + 1] * a[:, i:] - p) + a[:, i : i + 1] * b[:, i:] + b[:, i : i + 1] * a[:, i:]) + b[:, i : i + 1] * b[:, i:]
                e += y[:, i : i + 1] * z[:, i:] + z[:, i : i + 1] * y[:, i:]
                s, r = dd_total(*fast_two_sum(p, e))
                self.high[i, i:], self.low[i, i:] = dd_add(self.high[i, i:], self.low[i, i:], s, r)

    def batch(self, task: int) -> pa.RecordBatch:
        dim = len(self.high)
        lists = [pa.array([x[i, i:] for i in range(dim)], pa.list_(pa.float64())) for x in (self.high, self.low)]
        return pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([task] * dim, pa.int32()), *lists], names=["i", "task", "high", "low"])


@dataclass
class Centre:
    """Numbers of the fit list: how many vectors, their sums, and the mean in double-double."""

    n: int
    sums: list[int]

    def __post_init__(self):
        exact = [Fraction(s, self.n) for s in self.sums]
        self.high = np.array([float(x) for x in exact])
        self.low = np.array([float(x - Fraction(h)) for x, h in zip(exact, self.high.tolist(), strict=True)])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = two_sum(x.astype(float), -self.high)
        return fast_two_sum(s, e - self.low)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; numbers are taken from the first vector, which changes no difference."""
        if not len(x):
            return []
        base = x[0].copy()
        rest = x - base
        sums = [s - self.n * int(b) for s, b in zip(self.sums, base, strict=True)]
        most = self.n * int(np.abs(rest).max(initial=0)) + max(map(abs, sums))
        if most * most * len(sums) < 2**63:
            d = rest * self.n - np.array(sums, dtype=np.int64)
            return (d * d).sum(1).tolist()
        found = [sum((self.n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in rest.tolist()]
        return [v if v < 2**63 else None for v in found]


@dataclass
class Whitener:
    centre: Centre
    values: np.ndarray  # falling
    vectors: np.ndarray  # one column for each value
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.centred(x)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)


def integer_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(whole_vector("v"))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * float(scale)) + F.lit(shift).cast("long")).alias("x"))


@lean
def _tallies(batches):
    """(i, n, s, most) of a task: counts and sums by component."""
    n, sums, most = 0, None, 0
    for batch in batches:
        if batch.num_rows:
            x = vector_block(batch.column(0), len(sums) if sums is not None else len(batch.column(0)[0]))
            n, most = n + len(x), max(most, int(x.max()), -int(x.min()))
            if most >= 2**52:
                raise OverflowError("entries of 2^52 or more")
            # sums of halves: no row number makes them overflow
            both = np.stack([(x >> 26).sum(0), (x & (1 << 26) - 1).sum(0)]).astype(object)
            sums = both[0] * (1 << 26) + both[1] if sums is None else sums + both[0] * (1 << 26) + both[1]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([str(s) for s in sums])], names=["i", "n", "s"])


def centre_of(fit: DataFrame) -> Centre | None:
    """The centre of fit(x); a row for each component comes to the driver."""
    rows = fit.select("x").mapInArrow(_tallies, "i int, n long, s string")
    found = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of one length are needed")
    return Centre(found[0]["n"], [int(r["s"]) for r in found]) if found else None


def _outer(prepared):
    @lean
    def run(batches):
        make = prepared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                high, low = make(vector_block(batch.column(0), len(batch.column(0)[0])))
                total = total or OuterProducts(high.shape[1])
                total.add(high, low)
        if total:
            yield total.batch(TaskContext.get().partitionId())

    return run


def _merged(key, table):
    table = table.sort_by("task")
    width = len(table.column("high")[0])
    high, low = dd_total(*(vector_block(table.column(c), width) for c in ("high", "low")))
    first = table.slice(0, 1)
    return pa.table({"i": first.column("i"), "task": first.column("task"), "high": pa.array([high], pa.list_(pa.float64())), "low": pa.array([low], pa.list_(pa.float64()))})


class _Centred:
    def __init__(self, centre: Centre):
        self.centre = centre

    def __call__(self, x):
        return self.centre.centred(x)


class _Whitened:
    """Whitened rows and a last column of ones, whose products are the sums."""

    def __init__(self, whitener: Whitener):
        self.whitener = whitener

    def __call__(self, x):
        y = np.column_stack([self.whitener(x), np.ones(len(x))])
        return y, np.zeros_like(y)


def outer_products(fit: DataFrame, make) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y y' over the rows y = make(x) of fit, high and low parts; a task sends one row for each matrix row."""
    held = fit.sparkSession.sparkContext.broadcast(make)
    rows = fit.select("x").mapInArrow(_outer(held), _HALF)
    for keys in ((F.col("i"), F.col("task") % MERGES), (F.col("i"),)):
        rows = rows.groupBy(*keys).applyInArrow(_merged, _HALF)
    found = rows.orderBy("i").collect()
    high, low = np.zeros((len(found), len(found))), np.zeros((len(found), len(found)))
    for r in found:
        i = r["i"]
        high[i, i:], low[i, i:] = r["high"], r["low"]
        high[i:, i], low[i:, i] = r["high"], r["low"]
    return high, low


def fit_whitener(fit: DataFrame, centre: Centre, components: int = COMPONENTS) -> Whitener:
    high, low = outer_products(fit, _Centred(centre))
    cov = high / centre.n + low / centre.n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = np.flatnonzero(values > max(values[0], 0) * len(values) * np.finfo(float).eps)[:components]
    vectors = vectors[:, keep] * np.sign(vectors[np.abs(vectors[:, keep]).argmax(0), keep])
    return Whitener(centre, values[keep], vectors, values[keep] / np.trace(cov) if len(keep) else values[keep])


def identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    high, low = outer_products(fit, _Whitened(whitener))
    n = whitener.centre.n
    mean = high[-1, :-1] / n
    cov = high[:-1, :-1] / n + (low[:-1, :-1] / n - np.outer(mean, mean))
    return float(np.abs(cov - np.eye(len(cov))).max())


def _projecting(held):
    @lean
    def run(batches):
        w, error = held.value
        k = len(w.values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.num_rows
                x = vector_block(part.column(1), len(w.centre.sums))
                own = np.repeat(np.arange(n), k)
                arrays = [part.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, w.centre.n, np.int64)), pa.array(w.centre.deviation(x), pa.int64()).take(pa.array(own))]
                arrays += [pa.array(w(x).reshape(-1)), pa.array(np.tile(w.explained, n)), pa.array(np.full(n * k, error))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of vectors(vec_id, embedding), for each row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark, rows = vectors.sparkSession, integer_vectors(vectors, scale, shift)
    fit = stored(rows.select("x").distinct(), "fit-list")
    centre = centre_of(fit)
    whitener = fit_whitener(fit, centre, components) if centre else None
    if whitener is None or not len(whitener.values):
        discard(fit)
        return spark.createDataFrame([], schema)
    error = identity_error(fit, whitener)
    discard(fit)
    return rows.mapInArrow(_projecting(spark.sparkContext.broadcast((whitener, error))), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
