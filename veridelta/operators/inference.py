"""Paired t-tests of loss differences, per cell of a table, with false-discovery-rate correction."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.student import p_value, t_quantile
from ..plans.config import InferenceConfig

RESULT = ["row_count", "n", "paired_n", "tested_n", "excluded_unit_rows", "unit_count", "mean_loss_difference", "t_statistic", "df", "p_value", "q_value", "ci_low", "ci_high", "significant", "significance", "low_support", "status", "loss", "inference_unit", "correction", "alpha", "min_units"]


def paired_tests(rows: DataFrame, keys: list[str], config: InferenceConfig, min_count: int = 30) -> DataFrame:
    """A test for each cell of keys (one for all rows without keys). Effects are candidate less reference.

    Two aggregations: by unit, then by cell; the units' means carry their moments about the cell's mean."""
    a, b = (F.col(f"__ae_{s}") if config.loss == "absolute" else F.col(f"__error_{s}") * F.col(f"__error_{s}") for s in ("candidate", "reference"))
    d = F.when(finite(a).isNotNull() & finite(b).isNotNull(), finite(a - b))
    unit = {"record": None, "date": "__date", "entity": "__entity"}[config.unit]
    rows = rows.select(*keys, d.alias("d"), *([F.col(unit).alias("u")] if unit else []))
    if unit:
        units = rows.groupBy(*keys, "u").agg(F.count("*").alias("rows"), F.count("d").alias("valid"), F.avg("d").alias("m"))
        known = F.col("u").isNotNull() & (F.col("valid") > 0)
    else:
        units = rows.select(*keys, F.lit(1).cast("long").alias("rows"), F.col("d").isNotNull().cast("long").alias("valid"), F.col("d").alias("m"))
        known = F.col("valid") > 0
    m = F.when(known, F.col("m"))
    cell = units.groupBy(*keys).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("valid"), F.lit(0)).alias("paired_n"), F.coalesce(F.sum(F.when(known, F.col("valid"))), F.lit(0)).alias("tested_n"),
        F.count(m).alias("unit_count"), F.avg(m).alias("mean_loss_difference"), F.stddev_samp(m).alias("sd"), F.max(F.abs(m)).alias("largest"),
    )
    n, sd = F.col("unit_count"), F.col("sd")
    status = (
        F.when(F.col("paired_n") < F.col("row_count"), "invalid_loss").when(F.col("tested_n") < min_count, "low_rows").when(n < config.min_units, "low_units")
        .when(sd == 0, "zero_variance").when(sd <= F.col("largest") * (16 * sys.float_info.epsilon), "near_zero_variance").otherwise("ok")
    )
    cell = cell.withColumns({"n": F.col("paired_n"), "excluded_unit_rows": F.col("paired_n") - F.col("tested_n"), "status": status, "low_support": (F.col("tested_n") < min_count) | (n < config.min_units)})
    ok = F.col("status") == "ok"
    se = sd / F.sqrt(n.cast("double"))
    cell = cell.withColumns({"t_statistic": F.when(ok, finite(F.try_divide(F.col("mean_loss_difference"), se))), "df": F.when(ok, (n - 1).cast("double")), "se": F.when(ok, se)})
    cell = cell.withColumns({"p_value": p_value(F.col("t_statistic"), F.col("df")), "half": t_quantile(config.alpha, F.col("df")) * F.col("se")})
    cell = cell.withColumns({"p_value": finite(F.col("p_value")), "ci_low": finite(F.col("mean_loss_difference") - F.col("half")), "ci_high": finite(F.col("mean_loss_difference") + F.col("half"))})
    cell = cell.withColumn("status", F.when(ok & (F.greatest(*[F.col(c).isNull() for c in ("p_value", "t_statistic", "ci_low", "ci_high")]) | finite(F.col("mean_loss_difference")).isNull()), "invalid_result").otherwise(F.col("status")))
    out = corrected(cell, config.correction)
    q = F.col("q_value")
    out = out.withColumns({
        "significant": F.coalesce(q <= config.alpha, F.lit(False)), "significance": F.when(q <= 0.001, "***").when(q <= 0.01, "**").when(q <= 0.05, "*").otherwise(""),
        "loss": F.lit(config.loss), "inference_unit": F.lit(config.unit), "correction": F.lit(config.correction), "alpha": F.lit(float(config.alpha)), "min_units": F.lit(config.min_units),
    })
    return out.select(*keys, *RESULT)


def corrected(cells: DataFrame, correction: str) -> DataFrame:
    """q_value over the ok cells of a table, which is a row per cell: the windows are small."""
    ok = F.col("status") == "ok"
    tested = F.when(ok, F.col("p_value"))
    family = W.partitionBy(ok)
    by_p = family.orderBy(F.col("p_value").asc())
    m = F.count("*").over(family)
    rank = F.row_number().over(by_p)
    cells = cells.withColumns({"__m": m, "__rank": rank})
    if correction == "none":
        return cells.withColumn("q_value", tested)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("__m").cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k) if correction == "by" else F.lit(1.0)
    raw = tested * F.col("__m") / F.col("__rank") * harmonic
    cells = cells.withColumn("__raw", raw)
    lowest = F.min("__raw").over(W.partitionBy(ok).orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn("q_value", F.when(ok, F.least(lowest, F.lit(1.0))))
