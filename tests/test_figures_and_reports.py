"""Tables behind figures against numpy, source positions, reading guide, the whole bundle."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import veridelta as v
from veridelta.operators import figures, temporal, trees
from veridelta.plans import cli
from veridelta.plans.config import WalkForwardConfig


def column(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double").repartition(3)


@pytest.mark.parametrize("xs", [[float(x) for x in np.random.default_rng(1).normal(size=700)], [1.0], [2.0] * 9, [i / 10 for i in range(101)], [-1e308, 1e308, 0.0], [0.1, 0.2, 0.3, 0.7, 0.6], [0.0, 5e-324]])
def test_histogram(spark, xs):
    got = sorted(map(tuple, figures.histogram(column(spark, [*xs, None]), "x").collect()))
    bins = min(50, max(1, int(np.sqrt(len(xs)))))
    assert len(got) == bins and sum(r[3] for r in got) == len(xs)
    if max(map(abs, xs)) < 1e300 and max(xs) - min(xs) != 5e-324:
        n, edges = np.histogram(xs, bins)
        assert np.allclose([r[1] for r in got] + [got[-1][2]], edges)
        assert sum(abs(a - b[3]) for a, b in zip(n, got, strict=True)) <= 2  # edges differ in their last digit


def test_histogram_of_nothing(spark):
    assert figures.histogram(column(spark, [None]), "x").count() == 0 and figures.normal_quantiles(column(spark, [None]), "x").count() == 0
    with pytest.raises(ValueError):
        figures.histogram(column(spark, [1.0]), "x", 0)


def test_normal_quantiles(spark):
    from statistics import NormalDist

    got = sorted(map(tuple, figures.normal_quantiles(column(spark, [-1.0, 0.0, 1.0]), "x").collect()))
    assert np.allclose([r[2] for r in got], [-2 / 3, 0, 2 / 3]) and np.allclose([r[1] for r in got], [NormalDist().inv_cdf(p) for p in (1 / 6, 0.5, 5 / 6)])
    xs = np.random.default_rng(3).normal(size=900)
    got = sorted(map(tuple, figures.normal_quantiles(column(spark, list(map(float, xs))), "x").collect()))
    p = (np.arange(500) + 0.5) / 500
    assert np.allclose([r[2] for r in got], np.quantile(xs, p)) and len(got) == 500


@pytest.mark.parametrize("n, limit", [(7, 4), (7, 7), (7, 100), (1, 5), (0, 5), (1000, 333)])
def test_even_points(spark, n, limit):
    df = spark.range(n).select((F.col("id") * 3).alias("id"), F.col("id").cast("double").alias("x")).repartition(4)
    got = sorted(map(tuple, figures.even_points(df, ["id"], ["id"], limit).collect()))
    assert got == [(int(i), int(i) * 3) for i in (np.linspace(0, n - 1, min(n, limit), dtype=int) if n else [])]


def test_grids(spark):
    cells = spark.createDataFrame([("A", "big", -1.0), ("A", "small", 2.0), ("B", "big", -0.5)], "x string, y string, m double")
    assert sorted(map(tuple, figures.label_grid(cells, "m").collect())) == [("A", -1.0, 2.0), ("B", -0.5, None)]
    assert figures.label_grid(cells.limit(0), "m").columns == ["x"]
    many = spark.range(600).select(F.lit("a").alias("x"), F.col("id").cast("string").alias("y"), F.lit(1.0).alias("m"))
    with pytest.raises(ValueError):
        figures.label_grid(many, "m")
    with pytest.raises(ValueError):
        figures.label_grid(cells.withColumn("y", F.lit("x")), "m")


def test_remainder(spark):
    local = spark.createDataFrame([(1, f"f{i}", 0.0, float(c), float(c)) for i, c in enumerate((1, -5, 0.5, -1))] + [(2, "f0", 0.0, 1.0, 1.0)], "id int, feature string, feature_value double, shap_value double, shap_value_scaled double")
    got = sorted(tuple(r)[:3] + (r.shap_value_scaled,) for r in figures.with_remainder(local, "id", 2).collect())
    assert got == [(1, 1, "f1", -5.0), (1, 2, "f0", 1.0), (1, 3, "Other 2 features", -0.5), (2, 1, "f0", 1.0)]


def compared(spark, n=40):
    tree = trees.TreeEnsemble((trees.from_nested((0, 4.5, 10, (1.0, 5), (2.0, 5))),))
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i * 2, float(i % 10), float(i % 7), t0 + dt.timedelta(hours=6 * i), f"e{i % 3}", "ab"[i % 2]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, y double, t timestamp_ntz, e string, g string")
    return v.compare_models(df, "y", v.Model("one", tree, ("x",)), v.Model("two", trees.TreeEnsemble(tree.trees, 1.0), ("x",)), id_column="id", time_column="t", entity_column="e")


def test_positions_stay_with_their_rows(spark):
    c = compared(spark).with_positions().filter("g", values=["b"]).select_models("two", "one")
    worst = c.candidate_diagnostics([], top_n=5)["worst_cases"].collect()
    assert worst and all(r.source_position * 2 == r.id for r in worst) and all(r.source_position * 2 == r.id for r in c.cases().collect())
    out = c.shap_values("one", keys=c.worst_keys("one", limit=3))
    rows = out.tables["predictions"].collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in worst[:3]) and all(r.source_position * 2 == r.id for r in rows)
    assert out.settings["filters"] and out.settings["record_id_column"] == "id"
    with pytest.raises(ValueError):
        c.with_positions()


def test_the_whole_bundle(spark, tmp_path):
    c = compared(spark)
    c.shap_values("two", max_rows=None)
    folder = v.export(c, str(tmp_path), interactions=[("g", "e")], min_count=1, metric="p95_delta", temporal=v.TemporalConfig("1D", max_lag=2), candidate_population="paired", trades=v.TradeViewConfig(side_column="g"))
    manifest, page = json.loads((folder / "review.json").read_text()), (folder / "report.html").read_text()
    assert [s["column"] for s in manifest["slices"]] == ["__hour", "__date"] and manifest["temporal_population"] == "paired" and manifest["interactions"][0][1]["column"] == "e" and manifest["retained_models"] == ["one", "two"]
    assert manifest["candidate_top_n"] == 20 and manifest["explanations"]["shap:two"]["evaluated_rows"] == 40 and manifest["training_performed"] is False
    for name in ("interaction_01_grid", "slice_01", "candidate_figure_histogram", "candidate_figure_normal_quantiles", "candidate_figure_points", "trade_summary", "explanation_01_predictions", "temporal_guide"):
        assert (folder / f"{name}.csv").exists() and f"<h3>{name}</h3>" in page
    assert "g" in (folder / "candidate_worst_slices.csv").read_text() and c.summary().count() == 1
    topics = [line.split(",")[0] for line in (folder / "temporal_guide.csv").read_text().splitlines()[1:]]
    assert topics == ["coverage", "signal", "lags", "period", "level", "events"]
    audit = c.trade_diagnostics(v.TradeViewConfig(side_column="g"))["summary"]
    assert (audit["paired_rows"], audit["plotted_rows"], audit["color_role"], audit["missing_view_rows"], audit["frequency"], audit["singleton_entity_rows"]) == (40, 40, "side", 0, "1h", 0)
    for bad in (dict(metric="speed"), dict(candidate_population="all"), dict(temporal_population="x"), dict(candidate_top_n=0)):
        with pytest.raises(ValueError):
            v.export(c, str(tmp_path), **bad)


def test_walk_forward_bundle(spark, tmp_path):
    class Zero:
        def fit(self, train):
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(0.5))

    class One(Zero):
        pass

    t0 = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(days=i), 1.0, float(i % 2)) for i in range(12)], "id int, t timestamp_ntz, x double, y double")
    out = v.walk_forward_compare(df, "y", v.TrainableModel("z", Zero, ("x",)), v.TrainableModel("o", One, ("x",)), time_column="t", id_column="id", settings=WalkForwardConfig(4, 4))
    folder = v.export_walk_forward(out, str(tmp_path), min_count=1)
    manifest = json.loads((folder / "review.json").read_text())
    assert manifest["training_performed"] is True and manifest["evaluation_design"] == "walk_forward_cross_validation" and "Walk-forward validation" in (folder / "report.html").read_text()
    assert "train_finite_target_rows" in (folder / "fold_metrics.csv").read_text() and json.loads((folder / "walk_forward.json").read_text())["oof_rows"] == 8
    assert spark.read.parquet(str(folder / "oof_predictions.parquet")).count() == 8


def test_a_config_without_slices_takes_the_default_ones(spark, tmp_path):
    v.make_demo(spark, 60).write.parquet(str(tmp_path / "data.parquet"))
    cfg = {"data_path": "data.parquet", "output": "out", "comparison": {"actual": "actual", "reference": "reference_prediction", "candidate": "candidate_prediction", "time_column": "time"}}
    (tmp_path / "run.json").write_text(json.dumps(cfg))
    folder = cli.run_config(spark, str(tmp_path / "run.json"))
    assert (folder / "slice_02.csv").exists()
    (tmp_path / "none.json").write_text(json.dumps(cfg | {"slices": []}))
    assert not (cli.run_config(spark, str(tmp_path / "none.json")) / "slice_01.csv").exists()


def test_reading_guide_without_evidence(spark):
    summary = {"timed_rows": 0, "missing_time_rows": 3, "supported_bins": 0, "total_bins": 0, "missing_bins": 0, "frequency": "1D", "signal": "mae", "spectrum_status": "insufficient_bins", "changes_found": 0, "change_status": "disabled"}
    lags = spark.createDataFrame([(1, 2, None)], "lag_bins int, pair_n long, correlation double")
    events = spark.createDataFrame([(1, 0, 0, None)], "lag_events int, pair_n long, entity_n long, median_gap_seconds double")
    assert [r["topic"] for r in temporal.reading_guide(summary, lags, events)] == ["coverage", "signal", "lags", "period", "level"]
