"""Worked examples with exact values, and the edges of each operator."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

import veridelta as v
from veridelta.functions import columns, student
from veridelta.operators import diagnostics, folds, metrics, models, temporal, trades
from veridelta.plans import cli
from veridelta.plans.config import WalkForwardConfig, bin_micros


def compare(spark, rows, schema="actual double, a double, b double", **roles):
    return v.compare_predictions(spark.createDataFrame(rows, schema), "actual", "a", "b", **roles)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def close(x, y):
    return x == pytest.approx(y, rel=1e-6, abs=1e-6)


def test_metrics(spark):
    r = one(compare(spark, [(0.0, -1.0, 0.0), (0.0, 3.0, 2.0)]).summary())
    assert (r.reference_mae, r.candidate_mae, r.mae_delta, r.mae_improvement_pct, r.win_rate_pct, r.tie_rate_pct, r.low_support) == (2, 1, -1, 50, 100, 0, True)
    assert close((r.reference_rmse, r.candidate_rmse, r.reference_p95, r.candidate_p95), (2.236068, 1.414214, 2.9, 1.9)) and r.reference_bias == r.candidate_bias == 1


def test_coverage(spark):
    r = one(compare(spark, [(None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None), (1.0, 1.0, 1.0)]).coverage())
    assert (r.total, r.valid_target, r.reference_available, r.candidate_available, r.paired, r.excluded, r.missing_time, r.candidate_only_evaluable) == (4, 3, 2, 2, 1, 3, 1, 1)


def test_empty(spark):
    c = compare(spark, [])
    assert one(c.coverage()).total == 0 and one(c.summary()).n == 0 and c.slice("actual").count() == 0 and c.cases().count() == 0
    assert one(c.paired_test()).status == "low_rows" and c.candidate_diagnostics()["calibration"].count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("1", " 2 ", "1e3", "1d", "0x10", "inf", "", "True", None, "-.5")], "x string")
    assert [r[0] for r in df.select(columns.num("x", df.schema["x"].dataType)).collect()] == [1, 2, 1000, None, None, None, None, None, None, -0.5]


def test_offsets_and_scale(spark):
    c = compare(spark, [(105.0, 2.0, 3.0, 100.0), (1.0, 1.0, 1.0, None)], "actual double, a double, b double, o double", reference_offset="o", candidate_offset="o", error_scale=10.0)
    row = one(c.rows).asDict()
    assert (row["__reference"], row["__error_reference"], row["__error_candidate"]) == (102, -30, -20)


def test_left_out_date(spark):
    rows = [(0.0, 1.0, 0.0, "2026-01-01 00:00:00")] * 2 + [(0.0, 0.0, 2.0, "2026-01-02 00:00:00")]
    r = one(compare(spark, rows, "actual double, a double, b double, t string", time_column="t").stability())
    assert (r.dates, r.dated_rows, r.missing_date_rows, r.date_equal_delta, r.lodo_min, r.lodo_max) == (2, 3, 0, 0.5, -1, 2)


def test_t_test(spark):
    rows = [(0.0, 3.0, 2.0), (0.0, 3.0, 1.0), (0.0, 3.0, 0.0)]
    r = one(compare(spark, rows).paired_test(v.InferenceConfig(min_units=2), min_count=1))
    assert close((r.t_statistic, r.p_value, r.ci_low, r.ci_high), (-3.464102, 0.0741799, -4.484138, 0.484138)) and r.df == 2 and r.status == "ok"
    same = one(compare(spark, [(0.0, 3.0, 2.0)] * 3).paired_test(v.InferenceConfig(min_units=2), min_count=1))
    assert same.status == "zero_variance" and same.p_value is None and same.q_value is None and not same.significant
    swapped = one(v.compare_predictions(spark.createDataFrame(rows, "actual double, a double, b double"), "actual", "b", "a").paired_test(v.InferenceConfig(min_units=2), min_count=1))
    assert close(swapped.t_statistic, -r.t_statistic)


def test_student():
    assert close(student.two_sided(0, 5), 1) and close(student.two_sided(12.7062047, 1), 0.05) and close(student.quantile(0.05, 29), 2.0452296) and student.two_sided(20.95, 29) < 1e-15


def test_correction(spark):
    from veridelta.operators.inference import corrected

    df = spark.createDataFrame([(p, "ok") for p in (0.04, 0.001, 0.03)] + [(None, "low_rows")], "p_value double, status string")
    by = {r.p_value: r.q_value for r in corrected(df, "by").collect()}
    bh = {r.p_value: r.q_value for r in corrected(df, "bh").collect()}
    assert close([bh[0.04], bh[0.001], bh[0.03]], [0.04, 0.003, 0.04]) and close([by[0.04], by[0.001], by[0.03]], [0.0733333, 0.0055, 0.0733333]) and bh[None] is None
    assert all(r.q_value == r.p_value for r in corrected(df, "none").collect())


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.0, None, math.nan)], "x double")
    got = [r["group"] for r in metrics.with_label(df, v.Slice("x", (0, 1, 2), ("low", "high"))).collect()]
    assert got == ["low", "low", "high", "(outside bins)", "(missing/nonfinite)", "(missing/nonfinite)"]
    assert columns.bin_names((0, 10, 20), True) == ["(-0.001, 10.0]", "(10.0, 20.0]"] and columns.bin_names((0.0, 1.5, math.inf), False) == ["[0.0, 1.5)", "[1.5, inf)"]
    left = [r["group"] for r in metrics.with_label(df, v.Slice("x", (0, 1, 2), right=False)).collect()]
    assert left[:3] == ["[0.0, 1.0)", "[1.0, 2.0)", "(outside bins)"]


def test_top_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("A", "A", "B", "C", None)], "x string")
    assert [r["group"] for r in metrics.with_label(df, v.Slice("x", top_n=1)).collect()] == ["A", "A", "(other)", "(other)", "(missing)"]
    odd = spark.createDataFrame([("(other)",), ("(other)",), ("z",), (None,)], "x string")
    assert [r["group"] for r in metrics.with_label(odd, v.Slice("x", top_n=1)).collect()] == ["(other)", "(other)", "(other)*", "(missing)"]


def test_calibration_and_tail(spark):
    c = compare(spark, [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (2.0, 0.0, 3.0), (4.0, 0.0, 3.0)])
    assert [(r.n, r.mean_prediction, r.candidate_bias, r.candidate_mae) for r in diagnostics.calibration(c.candidate_rows, 2).orderBy("bin").collect()] == [(2, 1, 0, 1), (2, 3, 0, 1)]
    r = one(diagnostics.summary(compare(spark, [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 10.0)]).candidate_rows))
    assert close((r.tail_threshold, r.tail_n, r.tail_error_share_pct), (9, 1, 100))


def test_worst_slices_share(spark):
    rows = [(0.0, 0.0, float(i), "x" if i % 2 else "y") for i in range(10)]
    c = compare(spark, rows, "actual double, a double, b double, g string")
    got = c.candidate_diagnostics([v.Slice("g"), v.Slice("g", top_n=1)], min_count=1)["worst_slices"].collect()
    assert {r.spec for r in got} == {"g [1]", "g [2]"} and close(sum(r.error_share_pct for r in got if r.spec == "g [1]"), 100)


def series_of(spark, values, width="1h"):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(0.0, 0.0, x, t0 + dt.timedelta(hours=i), "e") for i, x in enumerate(values) if x is not None]
    c = compare(spark, rows, "actual double, a double, b double, t timestamp_ntz, e string", time_column="t", entity_column="e")
    return c, temporal.clock_series(c.candidate_rows, v.TemporalConfig(width, rolling_bins=2))


def test_series(spark):
    _, s = series_of(spark, [1.0, None, 2.0, 3.0])
    assert [(r.n, r.bias, r.rolling_signal) for r in s.orderBy("bin").collect()] == [(1, 1, 1), (0, None, 1), (1, 2, 2), (1, 3, 2.5)]


def test_autocorrelation(spark):
    _, s = series_of(spark, [1.0, None, 2.0, 3.0, 4.0, 5.0])
    r = {x.lag_bins: x for x in temporal.autocorrelation(s, v.TemporalConfig("1h", max_lag=20)).collect()}
    assert max(r) == 5 and r[1].pair_n == 3 and close(r[1].correlation, 1) and r[5].correlation is None
    _, flat = series_of(spark, [1.0] * 6)
    assert all(x.correlation is None for x in temporal.autocorrelation(flat, v.TemporalConfig("1h")).collect())


def test_spectrum(spark):
    _, s = series_of(spark, [math.sin(2 * math.pi * i / 12) for i in range(96)])
    table, context = temporal.spectrum(s, v.TemporalConfig("1h"))
    assert table.count() == 512 and context["spectrum_status"] == "ok" and abs(context["spectrum_peak_period_seconds"] - 12 * 3600) < 600 and context["spectrum_peak_power"] > 0.95
    assert temporal.spectrum(series_of(spark, [1.0, 2.0])[1], v.TemporalConfig("1h"))[1]["spectrum_status"] == "insufficient_bins"
    assert temporal.spectrum(series_of(spark, [1.0] * 30)[1], v.TemporalConfig("1h"))[1]["spectrum_status"] == "constant_signal"


def test_mean_shift(spark):
    import numpy as np

    found, _ = temporal.segment(np.array([0.0, 0, 4, 4]), 2, 0.0, 1)
    assert [f[1] for f in found] == [2] and close(found[0][3], 4)
    _, s = series_of(spark, [0.0, 0.1] * 10 + [5.0, 5.1] * 10)
    r = one(temporal.mean_shifts(s, v.TemporalConfig("1h")))
    assert (r.left_n, r.right_n, r.rank) == (20, 20, 1) and close(r.mean_after, 5.05)


def test_event_lags(spark):
    rows = [(0.0, 0.0, 1.0, dt.datetime(2026, 1, 1, 9), "A"), (0.0, 0.0, 3.0, dt.datetime(2026, 1, 1, 9), "A"), (0.0, 0.0, 1.0, dt.datetime(2026, 1, 1, 9, 1), "A")]
    c = compare(spark, rows, "actual double, a double, b double, t timestamp_ntz, e string", time_column="t", entity_column="e")
    r = one(temporal.event_lags(c.candidate_rows, 3))
    assert (r.distinct_events, r.tied_rows_collapsed, r.pair_n, r.median_gap_seconds, r.status) == (2, 1, 1, 60, "insufficient_pairs_or_constant")
    assert one(temporal.event_lags(c.candidate_rows.limit(0), 3)).status == "no_identified_timed_events" and temporal.event_lags(c.candidate_rows, 0).count() == 0


def test_local_times(spark):
    from pyspark.sql.types import TimestampNTZType

    df = spark.createDataFrame([(x,) for x in ("2026-11-01 01:30:00", "2026-03-08 02:30:00", "2026-06-01 12:00:00")], "x string").select(F.col("x").cast("timestamp_ntz").alias("x"))
    got = [r[0] for r in df.select(F.date_format(columns.utc_time("x", TimestampNTZType(), "America/New_York"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == [None, None, "2026-06-01 16:00"]


def days(spark, n):
    return spark.createDataFrame([(dt.datetime(2026, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(n)], "t timestamp_ntz, y double")


def test_folds(spark):
    got = v.plan_folds(days(spark, 12), "t", WalkForwardConfig(3, 2, 1, holdout_dates=2))
    assert [(f["validation_start"].day, f["validation_end"].day) for f in got] == [(5, 6), (7, 8), (9, 10)]
    assert len(v.plan_folds(days(spark, 12), "t", WalkForwardConfig(3, 2, 1, holdout_dates=2, n_splits=1))) == 1
    with pytest.raises(ValueError):
        v.plan_folds(days(spark, 3), "t")


def test_label_purge(spark):
    rows = [(dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 23, 59)), (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)), (dt.datetime(2026, 1, 1), None), (dt.datetime(2026, 1, 2), None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, known timestamp_ntz")
    r = one(folds.fold_counts(df, "t", WalkForwardConfig(1, 1, label_available_column="known")))
    assert (r.train_rows, r.label_purged_rows, r.validation_rows) == (1, 2, 1)


def test_adapters(spark):
    data = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "row_id string, y double")
    long = spark.createDataFrame([("1", "a", "Test", 1.0), ("1", "b", "Test", 2.0), ("2", "a", "Test", 3.0), ("2", "a", "Train", 9.0)], "row_id string, model string, stage string, prediction double")
    got = sorted(map(tuple, v.from_long_predictions(data, long, stage="Test").collect()))
    assert got == [("1", 1.0, 1.0, 2.0), ("2", 2.0, 3.0, None)]
    with pytest.raises(ValueError):
        v.from_long_predictions(data, long)
    with pytest.raises(ValueError):
        v.attach_predictions(data, data.unionAll(data).withColumnRenamed("y", "p"), on="row_id")
    with pytest.raises(ValueError):
        v.attach_predictions(data, data, on="row_id")


def test_filters(spark):
    c = compare(spark, [(0.0, 1.0, 2.0, "Straße"), (5.0, 1.0, 2.0, "x"), (9.0, 1.0, 2.0, None)], "actual double, a double, b double, g string")
    n = lambda **k: one(c.filter(**k).coverage()).total
    assert n(column="g", values=["STRASSE"], case_sensitive=False) == 1 and n(column="g", values=[]) == 0 and n(column="g") == 2 and n(column="g", values=["x"], include_missing=True) == 2
    assert n(column="actual", minimum=0, minimum_inclusive=False) == 2 and n(column="actual", maximum=5) == 2 and n(column="g", values=["aß"], match="contains") == 1
    with pytest.raises(ValueError):
        c.filter("actual", minimum=1, values=["x"])


def test_views(spark):
    rows = [(1.0, 2.0, 3.0, "e", 4.0), (3.0, 3.0, 3.0, "e", 16.0), (5.0, 5.0, 5.0, None, None)]
    c = compare(spark, rows, "actual double, a double, b double, e string, q double", entity_column="e")
    got = trades.view_coordinates(c.rows, v.TradeViewConfig(point_view="within_entity"), 1.0).orderBy("actual").collect()
    assert [r["__view_actual"] for r in got] == [-1, 1, None] and [r["__view_valid"] for r in got] == [True, True, False]
    points = trades.sampled_points(c.rows, [F.col("actual")], v.TradeViewConfig(side_column="e", quantity_column="q")).orderBy("actual").collect()
    assert [r["__view_size"] for r in points] == [76, 140, 12] and [r["__view_side"] for r in points] == ["Value: e", "Value: e", "Missing (not supplied)"]
    assert points[2]["__view_quantity_status"] == "unknown/nonpositive"


class Twice:
    def predict(self, frame):
        return frame["x"].to_numpy() * 2


def test_models(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("z")).withColumn("y", F.col("x") * 2)
    out = v.permutation_importance(df, "y", v.Model("m", Twice(), ("x", "z")), key="id", repeats=3)
    got = {r.feature_group: r.mae_increase for r in out.tables["importance"].collect()}
    assert got["z"] == 0 and got["x"] > 1 and one(out.tables["baseline"]).mae == 0
    lin = v.linear_contributions(df, ["x", "z"], [2.0, 1.0], 0.5, key="id", max_rows=1000)
    assert lin.tables["predictions"].join(df, "id").where("abs(prediction - (2 * x + z + 0.5)) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        v.tree_shap(df, v.Model("m", Twice(), ("x",)), key="id")
    again = models.predict(df, v.Model("m", Twice(), ("x", "z")), "p")
    assert models.inconsistent_predictions(again, "id", "y", "p").count() == 0
    c = v.compare_models(df, "y", v.Model("one", Twice(), ("x",)), v.Model("two", Twice(), ("z", "x")), id_column="id")
    assert one(c.summary()).candidate_mae == 0 and c.permutation_importance("one", repeats=2).tables["importance"].count() == 1


def test_checks(spark):
    with pytest.raises(ValueError):
        v.Roles("y", "y", "b")
    with pytest.raises(ValueError):
        v.Slice("x", (1, 1))
    with pytest.raises(ValueError):
        bin_micros("1M")
    with pytest.raises(ValueError):
        compare(spark, [(1.0, 1.0, 1.0, 1), (1.0, 1.0, 1.0, 1)], "actual double, a double, b double, id int", id_column="id")
    with pytest.raises(ValueError):
        temporal.bin_range(series_of(spark, [1.0, 2.0])[0].candidate_rows, 1, 100)


def test_bundle(spark, tmp_path):
    data = tmp_path / "data.parquet"
    v.make_demo(spark, 300).write.parquet(str(data))
    cfg = {"data_path": "data.parquet", "output": "out", "comparison": {"actual": "actual", "reference": "reference_prediction", "candidate": "candidate_prediction", "id_column": "row_id", "time_column": "time", "entity_column": "entity_id"}, "slices": ["segment", {"column": "measure_1", "bins": ["-inf", 5, "inf"]}], "temporal": {"frequency": "6h"}}
    (tmp_path / "run.json").write_text(json.dumps(cfg))
    folder = cli.run_config(spark, str(tmp_path / "run.json"))
    manifest = json.loads((folder / "review.json").read_text())
    assert manifest["coverage"]["paired"] == 300 and manifest["slices"][1]["bins"][0] == "-inf" and "<table>" in (folder / "report.html").read_text() and (folder / "temporal_series.csv").exists()
    first = cli.demo(spark, 300).fingerprint()
    assert first == cli.demo(spark, 300).fingerprint() and first != cli.demo(spark, 299).fingerprint()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n001,1.5\n1,2\n")
    df = v.read_data(str(tmp_path / "a.csv"), spark=spark, string_columns=["id"])
    assert [r.id for r in df.collect()] == ["001", "1"] and dict(df.dtypes)["x"] == "double"
    with pytest.raises(ValueError):
        v.read_data("a.xls", spark=spark)


def test_stream(spark, tmp_path):
    from veridelta.streaming.clock import streaming_bins

    src = tmp_path / "in"
    v.make_demo(spark, 100).write.parquet(str(src))
    roles = v.Roles("actual", "reference_prediction", "candidate_prediction", time_column="time")
    stream = streaming_bins(spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src)), roles, "1h")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n), count(*) FROM bins").first() == (100, 25)


def test_text_times_with_zones(spark):
    from veridelta.functions.columns import utc_time

    rows = ["2026-01-01 12:00:00+05:00", "2026-01-01T12:00:00Z", "2026-01-01 12:00:00", "2026-03-08 02:30:00", "2026-01-01", "soon", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    for zone, local in (("UTC", "2026-01-01 12:00:00"), ("America/New_York", "2026-01-01 17:00:00")):
        got = [r[0] for r in df.select(utc_time("t", df.schema["t"].dataType, zone).cast("string")).collect()]
        assert got[:3] == ["2026-01-01 07:00:00", "2026-01-01 12:00:00", local] and got[5:] == [None, None]
        assert (got[3] is None) == (zone != "UTC")


def test_cross_slices_of_clashing_columns(spark):
    rows = [(i, float(i), i + 1.0, i + 2.0, "ab"[i % 2], "cd"[i // 2 % 2]) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, actual double, a double, b double, seg string, x string")
    c = v.compare_predictions(df, "actual", "a", "b", id_column="id")
    want = [("a", "c", 2), ("a", "d", 2), ("b", "c", 2), ("b", "d", 2)]
    assert sorted((r["x"], r["y"], r["n"]) for r in c.cross_slice("seg", "x").collect()) == want
    assert sorted((r["x"], r["y"], r["row_count"]) for r in c.cross_slice_test("seg", "x", v.InferenceConfig(unit="record")).collect()) == want


def test_saved_prediction_without_the_model_s(spark):
    from veridelta.operators.models import inconsistent_predictions

    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 1.0, None), (4, None, None), (5, 1.0, 1.1)], "k int, s double, m double")
    assert sorted(r.k for r in inconsistent_predictions(df, "k", "s", "m").collect()) == [2, 3, 5]


def test_text_times_that_name_no_known_zone(spark):
    rows = ["2026-01-01 12:00:00 EST", "2026-01-01 12:00:00 PST", "2026-01-01 12:00 noon", "2026-01-01 12:00:00.5", "2026-1-2", "2026-01-01 12:00:00 UTC"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r[0] for r in df.select(columns.utc_time("t", df.schema["t"].dataType, "America/New_York").cast("string")).collect()]
    assert got == [None, None, None, "2026-01-01 17:00:00.5", "2026-01-02 05:00:00", "2026-01-01 12:00:00"]
    mixed = spark.createDataFrame([(1.0, 1.0, 2.0, "2026-01-01 12:00:00"), (1.0, 1.0, 2.0, "2026-01-01 12:00:00Z")], "y double, a double, b double, t string")
    with pytest.raises(ValueError, match="mixes"):
        v.compare_predictions(mixed, "y", "a", "b", time_column="t")
    assert v.compare_predictions(mixed.limit(1), "y", "a", "b", time_column="t").coverage().first().missing_time == 0
