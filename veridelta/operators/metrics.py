"""Paired error metrics: one aggregation for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import apart, bin_label, num
from ..functions.robust import safe_mean, safe_rms
from ..plans.config import Slice
from ..sources.tables import written
from .quantiles import with_quantiles

SIDES = ("reference", "candidate")
METRICS = ["n", "entities", "dates", *[f"{s}_{m}" for s in SIDES for m in ("mae", "rmse", "p95", "bias", "median", "within_tolerance_pct")], "mae_delta", "mae_improvement_pct", "p95_delta", "win_rate_pct", "tie_rate_pct", "low_support"]


def share(cond: Column) -> Column:
    """Percent of rows; NULL without rows."""
    return F.avg(F.when(cond, 100.0).otherwise(0.0))


def metrics(rows: DataFrame, keys: list[str] | None = None, *, tolerance: float = 1.0, min_count: int = 30) -> DataFrame:
    """A row for each group of keys, or one for all rows.

    The columns it needs are written once; sums and counts are one aggregation over them, quantiles a rank selection."""
    keys = keys or []
    thin = written(rows.select(*keys, "__entity", "__date", *[f"__{k}_{s}" for s in SIDES for k in ("error", "ae")]), "paired")
    aggs = [F.count("*").alias("n"), F.count_distinct("__entity").alias("entities"), F.count_distinct("__date").alias("dates")]
    for s in SIDES:
        e, a = F.col(f"__error_{s}"), F.col(f"__ae_{s}")
        aggs += [safe_mean(a).alias(f"{s}_mae"), safe_rms(e).alias(f"{s}_rmse"), safe_mean(e).alias(f"{s}_bias"), share(a <= tolerance).alias(f"{s}_within_tolerance_pct")]
    aggs += [share(F.col("__ae_candidate") < F.col("__ae_reference")).alias("win_rate_pct"), share(F.col("__ae_candidate") == F.col("__ae_reference")).alias("tie_rate_pct")]
    out = with_quantiles(thin.groupBy(*keys).agg(*aggs), thin, keys, {f"{s}_q": (f"__ae_{s}", [0.95, 0.5]) for s in SIDES})
    out = out.withColumns({f"{s}_{n}": F.col(f"{s}_q")[i] for s in SIDES for i, n in enumerate(("p95", "median"))})
    delta = F.col("candidate_mae") - F.col("reference_mae")
    out = out.withColumns({
        "mae_delta": delta, "mae_improvement_pct": F.when(F.col("reference_mae") > 0, -delta / F.col("reference_mae") * 100),
        "p95_delta": F.col("candidate_p95") - F.col("reference_p95"), "low_support": F.col("n") < min_count,
    })
    return out.select(*keys, *METRICS)


def with_label(rows: DataFrame, spec: Slice, name: str = "group") -> DataFrame:
    """rows with a slice's label and its place in display order.

    The most frequent labels are a table of at most top_n rows; ranks are over all rows given, ties by label."""
    order = f"{name}_order"
    if spec.bins is not None:
        label, place = bin_label(num(spec.column, rows.schema[spec.column].dataType), spec.bins, spec.labels, spec.right)
        return rows.withColumns({name: label, order: place})
    text = F.col(f"`{spec.column}`").cast("string")
    if spec.top_n is None:
        return rows.withColumns({name: F.coalesce(text, F.lit("(missing)")), order: F.when(text.isNull(), 1).otherwise(0)})
    counts = rows.select(text.alias("__label")).where("__label IS NOT NULL").groupBy("__label").count()
    top = counts.orderBy(F.desc("count"), "__label").limit(spec.top_n)
    # at most top_n rows, so they are brought to the driver and written into the expression: no join is left
    kept = [r[0] for r in top.collect()]
    other, missing = apart("(other)", kept), apart("(missing)", kept)
    known = F.create_map(*[F.lit(x) for i, k in enumerate(kept) for x in (k, i)]) if kept else None
    place = known[text] if kept else F.lit(None).cast("int")
    return rows.withColumns({
        name: F.when(text.isNull(), missing).when(place.isNotNull(), text).otherwise(other),
        order: F.when(text.isNull(), len(kept) + 1).otherwise(F.coalesce(place, F.lit(len(kept)))).cast("int"),
    })


def as_slice(spec: Slice | str, **options) -> Slice:
    return spec if isinstance(spec, Slice) else Slice(spec, **options)


def slice_metrics(rows: DataFrame, spec: Slice, **options) -> DataFrame:
    return metrics(with_label(rows, spec), ["group"], **options)


def cross_metrics(rows: DataFrame, x: Slice, y: Slice, **options) -> DataFrame:
    if x.column == y.column:
        raise ValueError("the two slices need two columns")
    # named x and y only after grouping: the data may have such columns, and y may be one of them
    return metrics(with_label(with_label(rows, x, "__x"), y, "__y"), ["__x", "__y"], **options).withColumnsRenamed({"__x": "x", "__y": "y"})


def daily(rows: DataFrame, **options) -> DataFrame:
    return metrics(rows.withColumn("date", F.coalesce("__date", F.lit("Unknown date"))), ["date"], **options)


def date_sensitivity(rows: DataFrame) -> DataFrame:
    """One row: the mean change with every date counting alike, and its range when one date is left out."""
    d = rows.groupBy("__date").agg(F.sum(F.col("__ae_candidate") - F.col("__ae_reference")).alias("s"), F.count("*").alias("k"))
    whole = W.partitionBy()  # one row per date
    known = d.where("__date IS NOT NULL").withColumns({"ts": F.sum("s").over(whole), "tk": F.sum("k").over(whole)})
    lodo = F.when(F.col("tk") > F.col("k"), (F.col("ts") - F.col("s")) / (F.col("tk") - F.col("k")))
    a = known.agg(F.count("*").alias("dates"), F.coalesce(F.sum("k"), F.lit(0)).alias("dated_rows"), F.avg(F.col("s") / F.col("k")).alias("date_equal_delta"), F.min(lodo).alias("lodo_min"), F.max(lodo).alias("lodo_max"))
    b = d.where("__date IS NULL").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("missing_date_rows"))
    return a.crossJoin(b).select("dates", "dated_rows", "missing_date_rows", "date_equal_delta", "lodo_min", "lodo_max")  # two tables of one row


def cases(rows: DataFrame, key: list, limit: int = 20, order: str = "harm") -> DataFrame:
    """The rows where the candidate harms or helps most, or has the largest errors."""
    if limit < 1 or order not in ("harm", "help", "absolute"):
        raise ValueError("limit must be positive and order harm, help or absolute")
    rows = rows.withColumn("loss_change", F.col("__ae_candidate") - F.col("__ae_reference"))
    by = {"harm": F.desc("loss_change"), "help": F.asc("loss_change"), "absolute": F.desc("__ae_candidate")}[order]
    return rows.orderBy(by, *key).limit(limit)
