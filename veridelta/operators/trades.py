"""Intraday bins of paired metrics, and a sample of points to plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import floor_bin, local_time, num
from ..plans.config import Roles, TradeViewConfig, bin_micros
from .metrics import METRICS, metrics
from .models import cohort
from .temporal import bin_range, grid


def focused(rows: DataFrame, roles: Roles, config: TradeViewConfig) -> DataFrame:
    if (config.focus_entity is not None or config.point_view == "within_entity") and not roles.entity_column:
        raise ValueError("map the entity column first")
    if config.focus_entity is None:
        return rows
    found = rows.where(F.col("__entity") == F.lit(config.focus_entity))
    if not found.limit(1).count():
        raise ValueError("focus_entity has no paired rows")
    return found


def auto_frequency(rows: DataFrame, requested: str) -> tuple[str, int, int]:
    """The frequency, and the number and span of local dates."""
    n, span = rows.agg(F.count_distinct("__date"), F.datediff(F.max("__date"), F.min("__date")) + 1).first()
    span = span or 0
    return ("30min" if span <= 3 else "1h" if span <= 14 else "1D") if requested == "auto" else requested, n, span


def intraday(rows: DataFrame, roles: Roles, config: TradeViewConfig, frequency: str) -> DataFrame:
    width = bin_micros(frequency)
    rows = rows.where("__time IS NOT NULL").withColumn("bin", floor_bin(F.col("__time"), width))
    low, high = bin_range(rows, width, config.max_bins) or (0, -1)
    found = metrics(rows, ["bin"], tolerance=roles.tolerance, min_count=config.min_count)
    out = grid(rows, low, high).join(found, "bin", "left")  # max_bins rows at most
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "entities", "dates")})
    at = lambda b: local_time(F.timestamp_micros(b * width), roles.timezone)
    out = out.withColumns({"supported": F.col("n") >= config.min_count, "time": at(F.col("bin")), "time_end": at(F.col("bin") + 1)}).withColumn("low_support", ~F.col("supported"))
    return out.select("time", "time_end", *METRICS, "supported")


def view_coordinates(rows: DataFrame, config: TradeViewConfig, scale: float) -> DataFrame:
    """rows with __view_actual, __view_reference, __view_candidate and __view_valid."""
    names = ("actual", "reference", "candidate")
    if config.point_view == "residual":
        values: dict[str, Column] = {"actual": F.lit(0.0), "reference": F.col("__error_reference"), "candidate": F.col("__error_candidate")}
    elif config.point_view == "level":
        values = {n: F.col(f"__{n}") for n in names}
    else:
        # the means are a row per entity and join back; a hot entity's rows stay spread out
        means = rows.where("__entity IS NOT NULL").groupBy(F.col("__entity").alias("__of")).agg(F.avg("__actual").alias("__mean"))
        rows = rows.join(means, F.col("__entity") == F.col("__of"), "left").drop("__of")
        values = {n: (F.col(f"__{n}") - F.col("__mean")) * F.lit(float(scale)) for n in names}
    out = rows.withColumns({f"__view_{n}": v for n, v in values.items()})
    return out.withColumn("__view_valid", F.expr("__view_actual IS NOT NULL AND __view_reference IS NOT NULL AND __view_candidate IS NOT NULL")).drop("__mean")


def category_label(rows: DataFrame, column: str | None, limit: int) -> Column:
    if column is None:
        return F.lit("Unmapped")
    text = F.col(f"`{column}`").cast("string")
    top = rows.select(text.alias("t")).where("t IS NOT NULL").groupBy("t").count().orderBy(F.desc("count"), "t").limit(limit)
    kept = [r[0] for r in top.collect()]  # at most 18
    return F.when(text.isNull(), "Missing (not supplied)").when(text.isin(kept) if kept else F.lit(False), F.concat(F.lit("Value: "), text)).otherwise("Other categories (display only)")


def sampled_points(rows: DataFrame, key: list, config: TradeViewConfig) -> DataFrame:
    """At most max_points rows, those of the smallest seeded hash of the key: the same for any partitioning."""
    color = config.side_column or config.dealer_column or config.counterparty_column
    labels = {"__view_side": category_label(rows, config.side_column, config.max_categories), "__view_color": category_label(rows, color, config.max_categories)}
    out = cohort(rows, key, config.max_points, config.random_state).withColumns(labels)
    q = num(config.quantity_column, rows.schema[config.quantity_column].dataType) if config.quantity_column else F.lit(None).cast("double")
    known = F.when(q > 0, q)
    whole = W.partitionBy()  # max_points rows at most
    out = out.withColumn("__q", known).withColumn("__top", F.max("__q").over(whole))
    size = F.lit(12.0) + F.lit(128.0) * F.sqrt(F.coalesce(F.try_divide(F.col("__q"), F.col("__top")), F.lit(0.0)))
    return out.withColumns({"__view_size": size, "__view_quantity_status": F.when(F.col("__q").isNotNull(), "positive").otherwise("unknown/nonpositive")}).drop("__q", "__top")


def entity_audit(rows: DataFrame) -> DataFrame:
    """One row: rows of entities that have a single one, and rows without an entity."""
    counts = rows.groupBy("__entity").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("__entity").isNotNull() & (F.col("n") == 1), 1)), F.lit(0)).alias("singleton_entity_rows"), F.coalesce(F.sum(F.when(F.col("__entity").isNull(), F.col("n"))), F.lit(0)).alias("missing_entity_rows"))


#: What the coordinates of each view are.
_VIEWS = {
    "residual": "prediction less actual in the error unit: zero is exact",
    "within_entity": "less the entity's mean actual over all paired rows, times the error scale: a look back, no feature; rows without an entity have none, an entity's only row is zero",
    "level": "levels in the source's unit; distances between entities can hide errors that matter",
}


def view_audit(whole: DataFrame, placed: DataFrame, points: DataFrame, bins: DataFrame, roles: Roles, config: TradeViewConfig) -> dict:
    """What the view shows and leaves out, in four small jobs: counts of rows, entities, points and bins."""
    n, timed, unplaced = placed.agg(F.count("*"), F.count("__time"), F.count_if(~F.col("__view_valid"))).first()
    shown, sampled = points.agg(F.count_if("__view_valid"), F.count("*")).first()
    total, supported, empty = bins.agg(F.count("*"), F.count_if("supported"), F.count_if(F.col("n") == 0)).first()
    roles_of_color = {"side": config.side_column, "dealer": config.dealer_column, "counterparty": config.counterparty_column}
    role = next((k for k, v in roles_of_color.items() if v), "unmapped")
    return {
        "paired_rows": n, "input_paired_rows": whole.count(), "timed_rows": timed, "missing_time_rows": n - timed, "timezone": roles.timezone, "clock": "bins of elapsed UTC time, labels in local time",
        "plotted_rows": shown, "sampled_rows": sampled, "sampled": sampled < n, "random_state": config.random_state, "total_bins": total, "supported_bins": supported, "empty_bins": empty, "min_count": config.min_count,
        "id_column": roles.id_column, "entity_column": roles.entity_column, "actual_column": roles.actual, "level_unit": "source target units", "error_unit": roles.unit, "point_view": config.point_view, "focus_entity": config.focus_entity,
        "view_note": _VIEWS[config.point_view], "missing_view_rows": unplaced, **entity_audit(placed).first().asDict(), "color_column": roles_of_color.get(role), "color_role": role, "side_encoding": "color",
        "symbol_encoding": "error of each prediction" if config.point_view == "residual" else "actual and each prediction", "point_sampling": "rows of the smallest seeded hash; metrics are of all rows", "size_scaling": "12 + 128 * sqrt(quantity / largest sampled quantity); 12 if unknown",
    }
