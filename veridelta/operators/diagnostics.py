"""Residual diagnostics of the candidate alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.robust import safe_mean, safe_rms, safe_total, share_of
from ..plans.config import Slice
from ..sources.tables import written
from .metrics import as_slice, share, with_label
from .quantiles import quantiles, with_quantiles

LEVELS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
ERRORS = ["n", "candidate_mae", "candidate_rmse", "candidate_bias", "candidate_median_ae", "candidate_p90", "candidate_p95", "candidate_p99", "candidate_within_tol_pct", "candidate_under_pct", "candidate_over_pct", "candidate_exact_pct", "low_support"]


QUANTILES = {"__q": ("__ae_candidate", [0.5, 0.9, 0.95, 0.99])}


def _errors(tolerance: float) -> list[Column]:
    e, a = F.col("__error_candidate"), F.col("__ae_candidate")
    return [
        F.count("*").alias("n"), safe_mean(a).alias("candidate_mae"), safe_rms(e).alias("candidate_rmse"), safe_mean(e).alias("candidate_bias"),
        share(a <= tolerance).alias("candidate_within_tol_pct"), share(e < 0).alias("candidate_under_pct"), share(e > 0).alias("candidate_over_pct"), share(e == 0).alias("candidate_exact_pct"),
    ]


def _named(out: DataFrame, min_count: int) -> DataFrame:
    """The quantiles by name, and the support."""
    return out.withColumns({k: F.col("__q")[i] for i, k in enumerate(("candidate_median_ae", "candidate_p90", "candidate_p95", "candidate_p99"))} | {"low_support": F.col("n") < min_count})


def error_stats(rows: DataFrame, keys: list[str] | None = None, *, tolerance: float = 1.0, min_count: int = 30) -> DataFrame:
    keys = keys or []
    thin = written(rows.select(*keys, "__error_candidate", "__ae_candidate"), "errors")
    return _named(with_quantiles(thin.groupBy(*keys).agg(*_errors(tolerance)), thin, keys, QUANTILES), min_count).select(*keys, *ERRORS)


def _tail(thin: DataFrame) -> DataFrame:
    """One row: the 95th percentile of absolute errors and their sum."""
    return with_quantiles(thin.agg(safe_total(F.col("__ae_candidate")).alias("__all")), thin, [], {"__t": ("__ae_candidate", [0.95])}).select(F.col("__t")[0].alias("tail_threshold"), "__all")


def summary(rows: DataFrame, *, tolerance: float = 1.0, min_count: int = 30) -> DataFrame:
    thin = written(rows.select("__error_candidate", "__ae_candidate", "__entity", "__date"), "errors")
    with_tail = thin.crossJoin(F.broadcast(_tail(thin)))  # one row
    a, beyond = F.col("__ae_candidate"), F.col("__ae_candidate") > F.col("tail_threshold")
    out = with_tail.agg(
        *_errors(tolerance), F.count_distinct("__entity").alias("entities"), F.count_distinct("__date").alias("dates"), F.count_if(F.col("__date").isNull()).alias("missing_date_rows"),
        F.max("tail_threshold").alias("tail_threshold"), F.count_if(beyond).alias("tail_n"), safe_total(F.when(beyond, a)).alias("__tail"), safe_total(a).alias("__all"),
    )
    out = _named(with_quantiles(out, thin, [], QUANTILES), min_count)
    out = out.withColumns({"tail_pct": F.try_divide(F.col("tail_n") * 100.0, F.col("n")), "tail_error_share_pct": F.when(F.col("n") > 0, share_of(F.col("__tail"), F.col("__all")))})
    return out.select(*ERRORS, "entities", "dates", "missing_date_rows", "tail_threshold", "tail_n", "tail_pct", "tail_error_share_pct")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """By quantile bins of the prediction; a prediction on an inner edge belongs to the lower bin."""
    if bins < 1:
        raise ValueError("bins must be positive")
    thin = written(rows.select("__candidate", "__actual", "__error_candidate", "__ae_candidate"), "calibration")
    edges = quantiles(thin, [], {"__edges": ("__candidate", [i / bins for i in range(bins + 1)])}).select(F.array_sort(F.array_distinct("__edges")).alias("__edges"))
    inner = F.expr("slice(__edges, 2, greatest(size(__edges) - 2, 0))")
    placed = thin.crossJoin(F.broadcast(edges)).withColumn("__bin", F.size(F.filter(inner, lambda e: e < F.col("__candidate"))))  # one row of edges
    out = placed.groupBy("__bin").agg(
        F.count("*").alias("n"), F.min("__candidate").alias("predicted_min"), F.max("__candidate").alias("predicted_max"), safe_mean(F.col("__candidate")).alias("mean_prediction"),
        safe_mean(F.col("__actual")).alias("mean_actual"), safe_mean(F.col("__error_candidate")).alias("candidate_bias"), safe_mean(F.col("__ae_candidate")).alias("candidate_mae"),
    )
    number = F.row_number().over(W.partitionBy().orderBy("__bin"))  # a row per bin
    return out.withColumn("bin", number).select("bin", "n", "predicted_min", "predicted_max", "mean_prediction", "mean_actual", "candidate_bias", "candidate_mae")


def residual_quantiles(rows: DataFrame) -> DataFrame:
    thin, levels = written(rows.select("__error_candidate"), "errors"), F.array(*[F.lit(x) for x in LEVELS])
    one = with_quantiles(thin.agg(F.count("*").alias("n")), thin, [], {"q": ("__error_candidate", LEVELS)}).withColumn("q", F.coalesce("q", F.array(*[F.lit(None).cast("double")] * len(LEVELS))))
    return one.select(F.explode(F.arrays_zip(levels.alias("quantile"), F.col("q").alias("signed_error"))).alias("z")).select(F.col("z.quantile").alias("quantile"), F.col("z.signed_error").alias("signed_error"))


def slice_names(specs: list[Slice]) -> list[str]:
    names = [s.name or s.column for s in specs]
    return [f"{n} [{i + 1}]" if names.count(n) > 1 else n for i, n in enumerate(names)]


def worst_slices(rows: DataFrame, specs: list[Slice | str], *, tolerance: float = 1.0, min_count: int = 30, top_n: int = 20) -> DataFrame:
    """All slices' groups from one pass: each row goes to its group of every slice."""
    specs = [as_slice(s) for s in specs]
    labelled = rows
    for i, s in enumerate(specs):
        labelled = with_label(labelled, s, f"__g{i}")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("spec_no"), F.lit(n).alias("spec"), F.lit(s.column).alias("column"), F.col(f"__g{i}").cast("string").alias("group"), F.col(f"__g{i}_order").alias("place")) for i, (s, n) in enumerate(zip(specs, slice_names(specs), strict=True))]))
    thin = written(labelled.select("__error_candidate", "__ae_candidate", each.alias("g")).select("__error_candidate", "__ae_candidate", "g.*"), "slices")
    keys = ["spec_no", "spec", "column", "group", "place"]
    # every slice holds all rows, so the first one has the population
    tail = _tail(thin.where("spec_no = 0"))
    a, beyond = F.col("__ae_candidate"), F.col("__ae_candidate") > F.col("tail_threshold")
    out = thin.crossJoin(F.broadcast(tail.drop("__all"))).groupBy(*keys).agg(*_errors(tolerance), safe_total(a).alias("__sum"), F.count_if(beyond).alias("tail_n"), safe_total(F.when(beyond, a)).alias("__tail"))  # one row
    out = _named(with_quantiles(out, thin, keys, QUANTILES), min_count).crossJoin(F.broadcast(tail.select("__all")))
    out = out.withColumns({"error_share_pct": share_of(F.col("__sum"), F.col("__all")), "tail_error_share_pct": share_of(F.col("__tail"), F.col("__all"))})
    return out.orderBy("low_support", F.desc("candidate_mae"), "spec_no", "place").limit(top_n).select("spec", "column", "group", *ERRORS, "error_share_pct", "tail_n", "tail_error_share_pct")


def worst_cases(rows: DataFrame, key: list, columns: list[str], top_n: int = 20) -> DataFrame:
    out = rows.withColumns({"signed_error": F.col("__error_candidate"), "abs_error": F.col("__ae_candidate")}).orderBy(F.desc("abs_error"), *key).limit(top_n)
    return out.select(*dict.fromkeys([*columns, "__actual", "__candidate", "signed_error", "abs_error", "__date", "__entity"]))


def candidate_daily(rows: DataFrame, **options) -> DataFrame:
    return error_stats(rows.where("__date IS NOT NULL"), ["__date"], **options)
