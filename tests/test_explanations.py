"""Tree contributions against all subsets, permutation refusals, progress, walk-forward refusals."""

import datetime as dt
import hashlib
import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import veridelta as v
from veridelta.operators import shap, trees
from veridelta.operators.progress import followed
from veridelta.plans import catalog
from veridelta.plans.config import WalkForwardConfig
from veridelta.plans.oracles import ORACLE_SQL

from oracle import differences


def grow(rnd, depth, features, cover=100):
    if depth == 0 or cover < 4 or rnd.random() < 0.15:
        return (float(rnd.normal()), cover)
    left = int(rnd.integers(1, cover))
    return (int(rnd.integers(features)), float(rnd.normal() / 2), cover, grow(rnd, depth - 1, features, left), grow(rnd, depth - 1, features, cover - left))


def expected(node, x, known):
    """A nested tree's expectation where only the features known are, by its definition."""
    if len(node) == 2:
        return node[0]
    f, t, n, a, b = node
    if f in known:
        return expected(a if x[f] <= t else b, x, known)
    size = lambda c: c[2 if len(c) > 2 else 1]
    return (size(a) * expected(a, x, known) + size(b) * expected(b, x, known)) / n


def shapley(specs, x, bias=0.0):
    m = len(x)
    value = lambda s: bias + sum(expected(t, x, s) for t in specs)
    out = np.zeros(m)
    for i in range(m):
        for k in range(m):
            for s in itertools.combinations([j for j in range(m) if j != i], k):
                out[i] += math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (value({*s, i}) - value(set(s)))
    return out, value(set())


def test_tree_contributions_are_shapley_values():
    rnd = np.random.default_rng(5)
    for trial in range(6):
        m = 5
        specs = [grow(rnd, 6, m) for _ in range(3)]
        model = trees.TreeEnsemble(tuple(map(trees.from_nested, specs)), 0.5)
        x = rnd.normal(size=(25, m))
        found = model.contributions(x)
        for row, phi in zip(x, found, strict=True):
            want, base = shapley(specs, row, 0.5)
            assert np.allclose(phi, want, atol=1e-12) and math.isclose(base, model.base, abs_tol=1e-12)
        assert np.allclose(found.sum(1) + model.base, model.predict(x), atol=1e-12)


def test_many_features_on_one_path():
    spec = (1.0, 1)
    for f in range(40):
        spec = (f, 0.0, 2 + f, spec, (float(f), 1))
    model = trees.TreeEnsemble((trees.from_nested(spec),))
    x = np.random.default_rng(1).normal(size=(50, 40))
    x[:5] = -1.0
    assert np.allclose(model.contributions(x).sum(1) + model.base, model.predict(x), atol=1e-10)
    assert model.contributions(np.zeros((0, 40))).shape == (0, 40) and trees.TreeEnsemble((), 2.0).predict(x).tolist() == [2.0] * 50


def test_models_of_spark(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    df = spark.range(300).select("id", *[(F.pmod(F.hash("id", F.lit(i)), F.lit(100)) / 10.0).alias(f"x{i}") for i in range(3)]).withColumn("y", F.col("x0") * 2 - F.col("x1") + F.when(F.col("x2") > 5, 3.0).otherwise(0.0))
    ready = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="v").transform(df)
    for learner in (DecisionTreeRegressor(maxDepth=4), RandomForestRegressor(numTrees=3, maxDepth=3, seed=1), GBTRegressor(maxIter=3, maxDepth=3, seed=1)):
        fitted = learner.setParams(featuresCol="v", labelCol="y").fit(ready)
        model = v.TreeEnsemble.of(fitted)
        rows = fitted.transform(ready).select("id", "x0", "x1", "x2", "y", "prediction")
        out = v.tree_shap(rows, v.Model("m", model, ("x0", "x1", "x2")), key="id", actual="y", max_rows=None, saved="prediction", max_local_rows=2)
        p = out.tables["predictions"]
        assert p.where("abs(additivity_error) > 1e-9").count() == 0 and p.count() == 300
        worst = [r.id for r in p.orderBy(F.desc(F.abs("residual")), "id").limit(2).collect()]
        assert [r.id for r in out.tables["local_contributions"].collect()] == [worst[0]] * 3 + [worst[1]] * 3
        assert out.tables["global_importance"].count() == 3 and shap.contributions(rows, v.Model("m", model, ("x0", "x1", "x2")), key="id").count() == 900


LEAF = lambda value, n: {"leaf_value": value, "leaf_count": n}


def test_nested_dumps():
    split = lambda f, t, n, a, b, **k: {"split_feature": f, "threshold": t, "internal_count": n, "left_child": a, "right_child": b, "decision_type": "<=", "default_left": True, "missing_type": "NaN"} | k
    tree = split(0, 0.5, 10, LEAF(1.0, 4), split(1, "1||3", 6, LEAF(2.0, 5), LEAF(5.0, 1), decision_type="=="))
    model = trees.from_dump({"objective": "regression", "tree_info": [{"tree_structure": tree}, {"tree_structure": {"leaf_value": 0.25}}]})
    x = np.array([[0.0, 9.0], [1.0, 3.0], [1.0, 2.0], [np.nan, 2.0], [1.0, np.nan]])
    assert model.predict(x).tolist() == [1.25, 2.25, 5.25, 1.25, 5.25]
    assert np.allclose(model.contributions(x).sum(1) + model.base, model.predict(x))
    zero = trees.from_dump({"tree_info": [{"tree_structure": split(0, -1.0, 2, LEAF(1.0, 1), LEAF(2.0, 1), missing_type="None")}]})
    assert zero.predict(np.array([[np.nan]])).tolist() == [2.0]
    for bad in ({"objective": "binary sigmoid:1", "tree_info": []}, {"tree_info": [{"tree_structure": split(0, 1.0, 2, LEAF(1.0, 1), LEAF(2.0, 1), missing_type="Zero")}]}, {"tree_info": [{"tree_structure": split(0, 1.0, 2, LEAF(1.0, 0), LEAF(2.0, 2))}]}):
        with pytest.raises(ValueError):
            trees.from_dump(bad)


class Off:
    """Trees whose predict is another than their sum."""

    def __init__(self, model):
        self.model = model

    def dump_model(self):
        return {"tree_info": [{"tree_structure": {"split_feature": 0, "threshold": 0.0, "internal_count": 2, "left_child": LEAF(1.0, 1), "right_child": LEAF(2.0, 1)}}]}

    def predict(self, frame):
        return np.exp(trees.from_dump(self.dump_model()).predict(frame))


def test_tree_shap_refusals(spark):
    spec = (0, 0.0, 2, (1.0, 1), (2.0, 1))
    model = v.Model("m", trees.TreeEnsemble((trees.from_nested(spec),)), ("x",), offset="o")
    df = spark.createDataFrame([(1, -1.0, 10.0, 12.0, 1.0), (2, 1.0, None, 12.0, 2.0), (3, 1.0, 10.0, None, 2.5), (4, 1.0, 10.0, 11.0, 2.0)], "id int, x double, o double, y double, saved double")
    out = v.tree_shap(df, model, key="id", actual="y")
    assert [(r.id, r.final_prediction, r.residual) for r in out.tables["predictions"].orderBy("id").collect()] == [(1, 11.0, -1.0), (4, 12.0, 1.0)]
    assert v.tree_shap(df, model, key="id", keys=[3]).tables["predictions"].collect()[0].final_prediction == 12.0
    big = v.tree_shap(df, model, key="id", actual="y", max_rows=1).tables["predictions"].count()
    assert big == 1
    for bad in (dict(keys=[2]), dict(keys=[3, 3]), dict(keys=[1, 9]), dict(saved="saved"), dict(max_rows=0), dict(max_local_rows=1001), dict(error_scale=0.0), dict(error_scale=1e308, actual="x")):
        with pytest.raises(ValueError):
            v.tree_shap(df, model, key="id", **({"keys": None} | bad)) if "saved" not in bad else v.tree_shap(df, model, key="id", saved="saved")
    for m in (v.Model("m", Off(None), ("x",)), v.Model("m", object(), ("x",)), v.Model("m", model.estimator, ("y",), offset="none")):
        with pytest.raises(ValueError):
            v.tree_shap(df, m, key="id")
    with pytest.raises(ValueError):
        v.tree_shap(df.limit(0), model, key="id")


class Plus:
    def predict(self, frame):
        return frame["x"].to_numpy() + frame["z"].to_numpy() * 0


class Root:
    def predict(self, frame):
        with np.errstate(invalid="ignore"):
            return np.sqrt(frame["x"].to_numpy() - frame["z"].to_numpy())


def test_permutation_refusals(spark):
    df = spark.range(20).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("z"), F.col("id").cast("double").alias("y"), (F.col("id") % 2).alias("g"), F.lit(None).cast("double").alias("o"))
    model = v.Model("m", Plus(), ("x", "z"))
    ok = v.permutation_importance(df, "y", model, key="id", shuffle_within="g", repeats=2)
    assert ok.settings["movable_records"] == 20 and ok.settings["prediction_calls"] == 5 and {r.feature_count for r in ok.tables["importance"].collect()} == {1}
    for bad in (dict(max_predictions=3), dict(groups={"x": ["x"]}), dict(groups={"a": []}), dict(groups={"a": ["q"]}), dict(include_individual=False), dict(shuffle_within="id"), dict(metric="mse"), dict(repeats=101), dict(max_rows=50_001), dict(saved="z")):
        with pytest.raises(ValueError):
            v.permutation_importance(df, "y", model, key="id", **bad)
    with pytest.raises(ValueError, match="two rows"):
        v.permutation_importance(df.limit(1), "y", model, key="id")
    with pytest.raises(ValueError, match="two rows"):
        v.permutation_importance(df, "y", v.Model("m", Plus(), ("x", "z"), offset="o"), key="id")
    steps = df.withColumn("z", F.col("x") - 1.0).withColumn("y", F.lit(1.0))
    with pytest.raises(ValueError, match="finite"):
        v.permutation_importance(steps, "y", v.Model("m", Root(), ("x", "z")), key="id")


def test_permutation_of_more_rows_than_a_sample(spark, tmp_path):
    """All rows of a larger table take part, as in SQL (a cut at 50,000 stood here before)."""
    at = str(tmp_path / "embeddings.parquet")
    rows = spark.range(50_040).select(F.col("id").alias("vec_id"), (F.col("id") % 7).cast("int").alias("label"), F.array(*[F.sin(F.col("id") * (i + 2)).cast("float") for i in range(4)]).alias("embedding"))
    rows.coalesce(1).write.parquet(at)
    found = catalog.QUERIES["permutation_importance"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/*.parquet')")
    assert set(found["n"]) == {50_040} and differences(found, con.execute(ORACLE_SQL["permutation_importance"]).fetchdf()) == []


def test_permutation_within_blocks(spark):
    """Values move within their block only, nulls being a block, and every value of a block is used once."""
    df = spark.range(60).select("id", (F.col("id") * 10 + F.coalesce(F.when(F.col("id") % 3 < 2, F.col("id") % 3), F.lit(5)) * 1000).cast("double").alias("x"), F.lit(0.0).alias("z"), F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"))
    out = v.permutation_importance(df.withColumn("y", F.col("x")), "y", v.Model("m", Plus(), ("x", "z")), key="id", shuffle_within="g", repeats=3, max_rows=None)
    own = {r.id: (r.x, r.g) for r in df.collect()}
    mixed = lambda g, f, r: sorted((k for k, (_, b) in own.items() if b == g), key=lambda k: (hashlib.md5(f"0:{k}:{f}:{r}".encode()).hexdigest(), k))
    for r in out.tables["repeats"].where("feature_group = 'x'").collect():
        moved = [abs(own[a][0] - own[b][0]) for g in (None, 0, 1) for a, b in zip(sorted(k for k, (_, h) in own.items() if h == g), mixed(g, "x", r.repeat), strict=True)]
        assert r.n == 60 and math.isclose(r.mae_increase, sum(moved) / 60) and max(moved) < 1000
    assert {r.mae_increase for r in out.tables["repeats"].where("feature_group = 'z'").collect()} == {0.0}


class Stop(Exception):
    pass


def test_progress_cancels_the_job(spark):
    def slow(batches):
        import time

        for b in batches:
            time.sleep(0.5)
            yield b

    seen = []

    def progress(state):
        seen.append(state)
        if state["completed"] >= 4:
            raise Stop

    df = spark.range(0, 400, 1, 40).mapInArrow(slow, "id long")
    with pytest.raises(Stop):
        followed(spark, "slow", df.count, progress)
    assert 4 <= seen[-1]["completed"] < seen[-1]["total"] and seen[0] == {"stage": "slow", "completed": 0, "total": 0}
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    done = []
    assert followed(spark, "count", spark.range(10).count, done.append) == 10 and done[-1]["completed"] == done[-1]["total"] > 0
    with pytest.raises(ZeroDivisionError):
        followed(spark, "wrong", lambda: 1 / 0, done.append)


def days(spark, n=12):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, t0 + dt.timedelta(days=i // 2), t0 + dt.timedelta(days=i // 2 + 1), float(i), float(i) * 2 + 1 if i % 5 else None, 0.5) for i in range(2 * n)]
    return spark.createDataFrame(rows, "id int, t timestamp_ntz, known timestamp_ntz, x double, y double, o double")


class Mean:
    """The mean label, whatever the features are."""

    def __init__(self, lose=False, name="prediction"):
        self.lose, self.name = lose, name

    def fit(self, train):
        assert set(train.columns) <= {"x", "label", "x2"}
        self.mean = train.agg(F.avg("label")).first()[0]
        return self

    def transform(self, rows):
        assert "y" not in rows.columns
        return (rows.where("x % 2 = 0") if self.lose else rows).withColumn(self.name, F.lit(self.mean))


class Double:
    def fit(self, train):
        return self

    def transform(self, rows):
        return rows.withColumn("x2", F.col("x") * 2)


def model(name="a", factory=Mean, features=("x",), **k):
    return v.TrainableModel(name, factory, features, **k)


def test_walk_forward_compare(spark):
    states = []
    out = v.walk_forward_compare(days(spark), "y", model("a"), model("b", transformer_factory=Double, offset="o"), time_column="t", settings=WalkForwardConfig(4, 3), id_column="id", min_count=1, progress=states.append)
    assert [f["validation_rows"] for f in out.folds] == [6, 6] and [f["train_rows"] for f in out.folds] == [6, 11]
    rows = {r.id: r for r in out.predictions.collect()}
    assert set(rows) == set(range(8, 20))
    first = np.mean([2 * i + 1 for i in range(8) if i % 5])
    assert rows[8].cv_1 == pytest.approx(first) and rows[8].cv_2 == pytest.approx(first) and rows[8].cv_fold == 1
    pooled = out.comparison.summary(1).collect()[0]
    assert pooled.n == sum(1 for i in range(8, 20) if i % 5)
    by_fold = sorted(out.fold_metrics.collect(), key=lambda r: r.fold_id)
    assert [(r.fold_id, r.train_finite_target_rows, r.validation_input_rows) for r in by_fold] == [(1, 6, 6), (2, 11, 6)]
    assert by_fold[0].candidate_bias - by_fold[0].reference_bias == pytest.approx(0.5)
    assert out.configuration["unscored_rows"] == 12 and states[0]["total"] == 4


def test_walk_forward_refusals(spark):
    df, used = days(spark), Mean()
    run = lambda a, b=None, data=df, **k: v.walk_forward_compare(data, "y", a, b or model("b"), time_column="t", **({"settings": WalkForwardConfig(4, 3)} | k))
    known = WalkForwardConfig(4, 3, label_available_column="known")
    for bad in (
        lambda: run(model("b")), lambda: run(model(features=("y",))), lambda: run(model(features=("known",)), settings=known), lambda: run(model(features=("q",))), lambda: run(model(features=())), lambda: run(model(features=("x", "x"))),
        lambda: run(model(offset="y")), lambda: run(model(offset="q")), lambda: run(model(factory=lambda: used)), lambda: run(model(factory=None)), lambda: run(model(factory=lambda: Mean(lose=True))), lambda: run(model(factory=lambda: Mean(name="p"))),
        lambda: run(model(), data=df.withColumn("cv_x", F.lit(1))), lambda: run(model(), data=df.withColumn("y", F.when(F.col("id") > 6, F.col("y")))), lambda: run(model(), data=df.unionAll(df), id_column="id"),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        run("a")
    with pytest.raises(TypeError):
        run(model(factory=object))


class Counting:
    def __init__(self, seen):
        self.seen = seen

    def predict(self, frame):
        self.seen.add(len(frame))
        return frame["x"].to_numpy()


def test_a_model_sees_each_row_once(spark):
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]
    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    c = v.compare_models(df, "y", v.Model("a", Counting(seen[0]), ("x",)), v.Model("b", Counting(seen[1]), ("x",)), id_column="id")
    assert c.summary().count() == 1 and c.coverage().count() == 1 and len(c.cases().collect()) == 20 and c.select_models("b", "a").summary().count() == 1
    assert [a.value for a in seen] == [100, 100]


def test_prepared_rows_are_read_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(60).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), (F.col("id") % 3).cast("string").alias("g"), F.lit(7).alias("unused"))
    source = df.select("*", F.lit(2.0).alias("z")).mapInArrow(count, "id long, x double, y double, g string, unused int, z double")
    c = v.compare_predictions(source, "y", "x", "z", id_column="id", check=False).prepare(["g"])
    want = v.compare_predictions(df.withColumn("z", F.lit(2.0)), "y", "x", "z", id_column="id")
    assert c.summary().collect() == want.summary().collect() and c.filter("g", values=["1"]).slice("g").collect() == want.filter("g", values=["1"]).slice("g").collect()
    assert c.prepare() is c and "unused" not in c.data.columns and made.value == 60
    assert c.select_models("Candidate", "Reference").summary().collect()[0].mae_delta == -want.summary().collect()[0].mae_delta
    c.release()


def test_shap_of_a_comparison(spark):
    tree = trees.TreeEnsemble((trees.from_nested((0, 4.5, 10, (1.0, 5), (2.0, 5))),))
    df = spark.range(10).select("id", F.col("id").cast("double").alias("x"), F.lit(1.5).alias("y"))
    c = v.compare_models(df, "y", v.Model("a", tree, ("x",)), v.Model("b", tree, ("x",)), id_column="id")
    out = c.shap_values("b", max_rows=None)
    assert out.tables["predictions"].count() == 10 and "shap:b" in c.explanations
    with pytest.raises(ValueError):
        c.shap_values("none")
