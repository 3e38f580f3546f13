"""Explanations of fitted trees: contributions of every feature to every explained row's prediction."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.columns import num
from ..functions.robust import safe_mean
from ..plans.config import Explanation, positive
from ..sources.tables import written
from .models import Model, checked_model, cohort, differ
from .progress import followed
from .trees import as_trees

#: What a model's trees may take, as every task holds them.
MODEL_BYTES = 256 << 20
RTOL, ATOL = 1e-5, 1e-6


def _explaining(held, names: list[str], batch_rows: int):
    def run(batches):
        trees, estimator = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                frame = pa.table([part.column(c) for c in names], names=names).to_pandas()
                values = trees.contributions(frame.to_numpy(dtype=float))
                raw = np.asarray(estimator.predict(frame), dtype=float).reshape(-1)
                if len(raw) != len(frame):
                    raise ValueError("predict must give one number per row")
                shap = pa.ListArray.from_arrays(pa.array(np.arange(len(frame) + 1) * len(names), pa.int32()), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw), shap], names=[*part.schema.names, "__raw", "__shap"])

    return run


def contributions(df: DataFrame, model: Model, *, key: str, batch_rows: int = 2000) -> DataFrame:
    """(key, feature, feature_value, shap_value, base_value) of every row and feature: lazy, no shuffle."""
    checked_model(model, 1.0)
    rows = df.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`") for c in model.features])
    return _long(_scored(rows, model, batch_rows), model, key).select(key, "feature", "feature_value", "shap_value", F.lit(as_trees(model.estimator).base).alias("base_value"))


def _scored(rows: DataFrame, model: Model, batch_rows: int) -> DataFrame:
    """rows with the features as numbers, the estimator's prediction and the contributions."""
    trees, names = as_trees(model.estimator), list(model.features)
    if trees.nbytes > MODEL_BYTES:
        raise ValueError(f"the trees take {trees.nbytes} bytes, more than {MODEL_BYTES}")
    if bad := {int(f) for t in trees.trees for f in t.feature if f >= len(names)}:
        raise ValueError(f"the trees use features beyond the model's list: {sorted(bad)}")
    rows = rows.select("*", *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(names)])
    held = rows.sparkSession.sparkContext.broadcast((trees, model.estimator if hasattr(model.estimator, "predict") else trees))
    schema = StructType([*rows.schema.fields, StructField("__raw", DoubleType()), StructField("__shap", ArrayType(DoubleType()))])
    return rows.mapInArrow(_explaining(held, names, batch_rows), schema)


def _long(scored: DataFrame, model: Model, key: str) -> DataFrame:
    """A row for each row and feature."""
    n = len(model.features)
    feature = F.element_at(F.array(*[F.lit(c) for c in model.features]), F.col("__i") + 1)
    value = F.element_at(F.array(*[F.col(f"__x{i}") for i in range(n)]), F.col("__i") + 1)
    kept = [F.col("__key").alias(key), *(["residual"] if "residual" in scored.columns else [])]
    return scored.select(*kept, F.posexplode("__shap").alias("__i", "shap_value"), *[f"__x{i}" for i in range(n)]).withColumns({"feature": feature, "feature_value": value})


def explained_rows(df: DataFrame, model: Model, *, key: str, actual: str | None, max_rows: int | None, keys: list | None, random_state: int) -> DataFrame:
    """The rows to explain: those with a finite offset and, where actual is given, a finite actual; all of them, the
    max_rows of the smallest seeded hash, or those named by their keys."""
    kinds = {f.name: f.dataType for f in df.schema}
    if missing := [c for c in [key, *model.features, *([actual] if actual else []), *([model.offset] if model.offset else [])] if c not in kinds]:
        raise ValueError(f"no such columns: {missing}")
    number = lambda c: num(c, kinds[c]) if c else F.lit(None).cast("double")
    rows = df.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`") for c in model.features], (number(model.offset) if model.offset else F.lit(0.0)).alias("__offset"), number(actual).alias("__actual"))
    valid = F.col("__offset").isNotNull() & (F.col("__actual").isNotNull() if actual else F.lit(True))
    if keys is None:
        rows = rows.where(valid)
        return rows if max_rows is None else cohort(rows, [F.col("__key")], max_rows, random_state)
    if len(set(keys)) != len(keys) or (max_rows is not None and len(keys) > max_rows):
        raise ValueError("keys must be distinct and no more than max_rows")
    found = rows.where(F.col("__key").isin(list(keys)))
    n, usable = found.agg(F.count("*"), F.count_if(valid)).first()
    if n != len(keys) or usable != n:
        raise ValueError("each key must name one row with a finite offset and actual value")
    return found


def tree_shap(df: DataFrame, model: Model, *, key: str, actual: str | None = None, max_rows: int | None = 500, max_local_rows: int = 20, keys: list | None = None, error_scale: float = 1.0, random_state: int = 0, batch_rows: int = 2000, saved: str | None = None, progress: Callable[[dict], None] | None = None) -> Explanation:
    """Path-dependent TreeSHAP of a model's trees. max_rows None explains every row.

    The trees are broadcast, their size checked; a row's contributions are computed in Arrow batches, once, and written
    with its prediction; all tables are read from there. Predictions are the estimator's own, so contributions that
    don't add up to them (another output than the trees' sum) are an error, as are predictions unlike the column saved.

    Tables: global_importance by feature, predictions by row, local_contributions of the max_local_rows rows of the
    largest residuals (the smallest keys without actual)."""
    checked_model(model, error_scale)
    positive("max_local_rows", max_local_rows, 1, 1000)
    positive("batch_rows", batch_rows)
    if max_rows is not None:
        positive("max_rows", max_rows)
    trees, spark, names = as_trees(model.estimator), df.sparkSession, list(model.features)
    rows = explained_rows(df, model, key=key, actual=actual, max_rows=max_rows, keys=keys, random_state=random_state)
    if saved:
        # by key, so that a name taken by a feature is no trouble
        rows = rows.join(df.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{saved}`").cast("double").alias("__saved")), F.col("__key").eqNullSafe(F.col("__k"))).drop("__k")
    done = followed(spark, "Tree SHAP", lambda: written(_scored(rows, model, batch_rows), "shap"), progress)
    total = F.aggregate("__shap", F.lit(0.0), lambda a, x: a + x)
    final = F.col("__raw") + F.col("__offset")
    done = done.withColumns({"base_value": F.lit(trees.base), "shap_sum": total}).withColumn("reconstructed_raw", F.col("base_value") + F.col("shap_sum"))
    done = done.withColumns({"final_prediction": final, "residual": (final - F.col("__actual")) * F.lit(float(error_scale))})
    bad = lambda c: F.isnan(c) | (F.abs(c) == math.inf)
    number = F.col("reconstructed_raw")
    checks = done.agg(
        F.count("*").alias("n"), F.count_if(bad(number) | bad(F.col("__raw"))).alias("nonfinite"), F.count_if(F.abs(number - F.col("__raw")) > F.lit(ATOL) + F.lit(RTOL) * F.abs(F.col("__raw"))).alias("apart"),
        F.count_if(bad(final) | F.coalesce(bad(F.col("residual")), F.lit(False)) | F.exists("__shap", lambda x: bad(x * float(error_scale)))).alias("overflow"), (F.count_if(differ(F.col("__saved"), F.col("__raw"))) if saved else F.lit(0)).alias("unlike"),
    ).first()
    for wrong, text in (
        (not checks["n"], "no eligible rows remain to explain"), (checks["nonfinite"], "predictions or contributions aren't finite"), (checks["apart"], "contributions don't add up to the model's predictions: another output transform or number of trees; use permutation importance"),
        (checks["overflow"], "the error scale or the offset overflows"), (checks["unlike"], "the model's predictions aren't the saved ones: build the comparison again"),
    ):
        if wrong:
            raise ValueError(text)
    scale = float(error_scale)
    long = _long(done, model, key)
    scaled = F.col("shap_value") * scale
    overall = long.groupBy("__i").agg(safe_mean(F.abs(scaled)).alias("mean_abs_shap"), safe_mean(scaled).alias("mean_signed_shap"), F.count("*").alias("n"))
    overall = overall.select(F.element_at(F.array(*[F.lit(c) for c in names]), F.col("__i") + 1).alias("feature"), "mean_abs_shap", "mean_signed_shap", "n", "__i").orderBy(F.desc("mean_abs_shap"), "__i").drop("__i")
    worst = [F.desc(F.abs("residual")), F.col(key)] if actual else [F.col(key)]
    local = long.orderBy(*worst, "__i").limit(max_local_rows * len(names)).select(key, "feature", "feature_value", "shap_value", scaled.alias("shap_value_scaled"))
    predictions = done.select(F.col("__key").alias(key), "base_value", "shap_sum", F.col("__raw").alias("raw_prediction"), "reconstructed_raw", F.col("__offset").alias("offset"), "final_prediction", (F.col("reconstructed_raw") + F.col("__offset")).alias("reconstructed_final"), (F.col("reconstructed_raw") - F.col("__raw")).alias("additivity_error"), *([F.col("__actual").alias("actual"), "residual"] if actual else []))
    settings = {"method": "tree_shap", "perturbation": "tree_path_dependent", "model": model.name, "actual": actual, "error_scale": scale, "evaluated_rows": checks["n"], "max_rows": max_rows, "max_local_rows": max_local_rows, "random_state": random_state, "offset": model.offset, "trees": len(trees.trees), "additivity_rtol": RTOL, "additivity_atol": ATOL, "saved": saved, "row_selection": "keys" if keys is not None else "all" if max_rows is None else "smallest seeded hash"}
    notes = ("Contributions explain the fitted prediction, not accuracy and no cause.", "Expectations follow the trees' own paths and the numbers of training rows at their nodes.", "The offset is a row's own and no contribution.")
    if keys is not None:
        notes += ("Rows chosen by key are no sample: means describe these rows only.",)
    return Explanation({"global_importance": overall, "local_contributions": local, "predictions": predictions}, settings, notes)


