"""Exact quantiles against numpy, statistics of extreme values, and lags within entities of any size."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import veridelta as v
from veridelta.functions import robust
from veridelta.operators import diagnostics, quantiles, temporal

LEVELS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]


@pytest.fixture(scope="module")
def groups():
    rnd = np.random.default_rng(1)
    many = {"normal": rnd.normal(size=500), "ties": np.r_[np.zeros(300), rnd.normal(size=100)], "one": [5.0], None: 1.7e9 + rnd.random(400) * 1e-3, "none": [None, None], "tiny": rnd.random(50) * 1e-310, "near": 1 + np.arange(200) * 2.0**-52}
    return [(g, None if x is None else float(x), float(i)) for g, xs in many.items() for i, x in enumerate(xs)]


@pytest.mark.parametrize("few", [1_000_000, 50, 1])
def test_quantiles(spark, groups, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    df = spark.createDataFrame(groups, "g string, x double, y double").repartition(3)
    found = {r.g: r for r in quantiles.quantiles(df, ["g"], {"qx": ("x", LEVELS), "qy": ("y", [0.5])}).collect()}
    for g in {r[0] for r in groups}:
        xs, ys = [r[1] for r in groups if r[0] == g and r[1] is not None], [r[2] for r in groups if r[0] == g]
        assert found[g].qy == [np.quantile(ys, 0.5)]
        assert found[g].qx is None if not xs else np.allclose(found[g].qx, np.quantile(xs, LEVELS), rtol=1e-14, atol=0)


def test_quantiles_of_nothing(spark, groups):
    df = spark.createDataFrame(groups, "g string, x double, y double")
    assert quantiles.quantiles(df.limit(0), ["g"], {"q": ("x", [0.5])}).count() == 0
    assert quantiles.with_quantiles(df.limit(0).agg(F.count("*").alias("n")), df.limit(0), [], {"q": ("x", [0.5])}).collect()[0].q is None
    with pytest.raises(ValueError):
        quantiles.quantiles(df.withColumnRenamed("g", "lo"), ["lo"], {"q": ("x", [0.5])})


def test_extreme_errors(spark):
    """Errors of 1e308 have finite means, roots, quantiles and shares."""
    rows = [(0.0, -1e308, 1e308), (0.0, 1e308, 1e308), (0.0, 1e308, -1e308)]
    c = v.compare_predictions(spark.createDataFrame(rows, "actual double, a double, b double"), "actual", "a", "b")
    r = c.summary().collect()[0]
    assert r.candidate_mae == pytest.approx(1e308, rel=1e-12) and r.candidate_rmse == pytest.approx(1e308, rel=1e-12) and r.candidate_bias == pytest.approx(1e308 / 3, rel=1e-12)
    assert r.candidate_p95 == r.candidate_median == 1e308 and r.mae_delta == 0
    s = diagnostics.summary(c.candidate_rows).collect()[0]
    assert s.candidate_mae == pytest.approx(1e308, rel=1e-12) and s.tail_error_share_pct == 0
    q = {x.quantile: x.signed_error for x in diagnostics.residual_quantiles(c.candidate_rows).collect()}
    assert q[0.5] == 1e308 and q[0.25] == pytest.approx(0, abs=1e294) and q[0.01] == pytest.approx(-1e308 * 0.96, rel=1e-12)
    assert {x.candidate_mae for x in diagnostics.calibration(c.candidate_rows, 2).collect()} == {1e308}


@pytest.mark.parametrize("xs", [[3.0, -4.0], [1e-200, 2e-200], [1e200, 1e-200, -1e200], [0.0, 0.0], [1e308, 1e308, 1.0], [5e-324], [2.0**900, 2.0**470, 2.0**-450, 1.0], [None], []])
def test_robust_sums(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    t = robust.safe_total(F.col("x"))
    got = df.agg(robust.safe_mean(F.col("x")).alias("mean"), robust.safe_rms(F.col("x")).alias("rms"), t.alias("t")).select("mean", "rms", robust.share_of(F.col("t"), F.col("t")).alias("share")).collect()[0]
    xs = [x for x in xs if x is not None]
    if not xs:
        assert (got.mean, got.rms, got.share) == (None, None, 0)
        return
    from fractions import Fraction

    mean, square = sum(map(Fraction, xs)) / len(xs), sum(Fraction(x) ** 2 for x in xs) / len(xs)
    assert got.mean == pytest.approx(float(mean), rel=1e-12)
    scale = Fraction(max(map(abs, xs))) or Fraction(1)
    assert got.rms == pytest.approx(math.sqrt(square / scale**2) * float(scale), rel=1e-12)


@pytest.mark.parametrize("size", [3, 7, 100_000])
def test_event_lags_of_a_hot_entity(spark, monkeypatch, size):
    """However the events are cut into windows, every pair of one entity is found."""
    monkeypatch.setattr(temporal, "WINDOW_EVENTS", size)
    rnd, t0, lag = np.random.default_rng(2), dt.datetime(2026, 1, 1), 4
    rows = [(0.0, 0.0, float(rnd.normal()), t0 + dt.timedelta(seconds=int(i * 7 + rnd.integers(7))), "hot" if i % 3 else f"e{i % 5}") for i in range(90)]
    c = v.compare_predictions(spark.createDataFrame(rows, "actual double, a double, b double, t timestamp_ntz, e string").repartition(5), "actual", "a", "b", time_column="t", entity_column="e")
    found = {r.lag_events: r for r in temporal.event_lags(c.candidate_rows, lag).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        by.setdefault(r[4], []).append(r)
    for k in range(1, lag + 1):
        pairs = [(e[i - k][2], e[i][2], (e[i][3] - e[i - k][3]).total_seconds()) for e in by.values() for i in range(k, len(e))]
        x, y, gap = map(np.array, zip(*pairs, strict=True))
        r = found[k]
        assert (r.pair_n, r.entity_n) == (len(pairs), sum(len(e) > k for e in by.values()))
        assert r.correlation == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.median_gap_seconds == pytest.approx(np.median(gap)) and r.p90_gap_seconds == pytest.approx(np.quantile(gap, 0.9))
