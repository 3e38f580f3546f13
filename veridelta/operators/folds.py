"""Walk-forward validation on dates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import local_time, num, utc_time
from ..plans.config import WalkForwardConfig
from ..sources.tables import written
from .progress import followed

#: A calendar has a few thousand dates; more than this many distinct ones are no dates.
MAX_DATES = 200_000


def with_day(data: DataFrame, time_column: str, zone: str = "UTC", name: str = "__day") -> DataFrame:
    at = utc_time(time_column, data.schema[time_column].dataType, zone)
    return data.withColumn(name, F.to_date(local_time(at, zone)))


def plan_folds(data: DataFrame, time_column: str, config: WalkForwardConfig | None = None, *, zone: str = "UTC") -> list[dict]:
    """Folds as date ranges; only the distinct dates come to the driver."""
    config = config or WalkForwardConfig()
    days = with_day(data, time_column, zone).select("__day").distinct().limit(MAX_DATES + 1).collect()
    if any(r[0] is None for r in days):
        raise ValueError("walk-forward needs a valid time in every row")
    if len(days) > MAX_DATES:
        raise ValueError(f"more than {MAX_DATES} distinct dates")
    dates = sorted(r[0] for r in days)
    kept = dates[: max(0, len(dates) - config.holdout_dates - config.holdout_embargo_dates)]
    step = config.step_dates or config.validation_dates
    starts = list(range(config.min_train_dates + config.embargo_dates, len(kept) - config.validation_dates + 1, step))
    starts = starts[-config.n_splits :] if config.n_splits else starts
    if not starts:
        raise ValueError("too few dates for one fold")
    out = []
    for fold, start in enumerate(starts, 1):
        stop = start - config.embargo_dates
        first = max(0, stop - config.max_train_dates) if config.max_train_dates else 0
        validation = kept[start : start + config.validation_dates]
        out.append({"fold": fold, "train_start": kept[first], "train_end": kept[stop - 1], "validation_start": validation[0], "validation_end": validation[-1], "train_dates": stop - first, "validation_dates": len(validation)})
    return out


_FOLD = "fold int, train_start date, train_end date, validation_start date, validation_end date, train_dates int, validation_dates int"


def fold_counts(data: DataFrame, time_column: str, config: WalkForwardConfig | None = None, *, zone: str = "UTC") -> DataFrame:
    """The folds with their rows: counted by date first, so that the range join meets a row per date and label date only."""
    config = config or WalkForwardConfig()
    folds = data.sparkSession.createDataFrame(plan_folds(data, time_column, config, zone=zone), _FOLD)
    days = with_day(data, time_column, zone)
    if config.label_available_column:
        at = utc_time(config.label_available_column, data.schema[config.label_available_column].dataType, zone)
        days = days.withColumn("__label", local_time(at, zone))
    else:
        days = days.withColumn("__label", F.lit(None).cast("timestamp"))
    per = days.groupBy("__day", F.to_date("__label").alias("__label_day")).count()
    train = F.expr("__day BETWEEN train_start AND train_end")
    known = F.lit(True) if not config.label_available_column else F.coalesce(F.col("__label_day") < F.col("validation_start"), F.lit(False))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    joined = per.join(F.broadcast(folds), F.expr("__day BETWEEN train_start AND validation_end"))  # folds: at most a row per date
    return joined.groupBy(*[c.split()[0] for c in _FOLD.split(", ")]).agg(n(train & known).alias("train_rows"), n(F.expr("__day BETWEEN validation_start AND validation_end")).alias("validation_rows"), n(train & ~known).alias("label_purged_rows"), n(train).alias("scheduled_train_rows"))


def fold_rows(data: DataFrame, time_column: str, fold: dict, config: WalkForwardConfig, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(train, validation) of one fold; both are filters on the day, with labels known before validation starts."""
    days = with_day(data, time_column, zone)
    train = days.where(F.col("__day").between(F.lit(fold["train_start"]), F.lit(fold["train_end"])))
    if config.label_available_column:
        at = utc_time(config.label_available_column, data.schema[config.label_available_column].dataType, zone)
        train = train.where(local_time(at, zone) < F.lit(fold["validation_start"]).cast("timestamp"))
    valid = days.where(F.col("__day").between(F.lit(fold["validation_start"]), F.lit(fold["validation_end"])))
    return train.drop("__day"), valid.drop("__day")


@dataclass(frozen=True)
class TrainableModel:
    """A regressor that is fitted anew for every fold.

    factory() gives an unfitted estimator: its fit(DataFrame) takes the features and the column label, and gives a model
    whose transform(DataFrame) adds the column prediction, as spark.ml's estimators and pipelines do.
    transformer_factory() may give an estimator fitted on the training rows first, whose model's transform() adds columns.
    Neither ever sees another column of the data. offset is a column that is added to predictions."""

    name: str
    factory: Callable[[], object]
    features: tuple[str, ...]
    transformer_factory: Callable[[], object] | None = None
    offset: str | None = None


@dataclass(frozen=True)
class WalkForwardResult:
    """The comparison of the out-of-fold predictions, these rows, the folds, their metrics, and how it was made."""

    comparison: object
    predictions: DataFrame
    folds: list[dict]
    fold_metrics: DataFrame
    configuration: dict


def _checked(model: TrainableModel, columns: list[str], outcomes: set) -> None:
    if not isinstance(model, TrainableModel):
        raise TypeError("give TrainableModel(name, factory, features, transformer_factory, offset)")
    if not isinstance(model.name, str) or not model.name.strip() or not callable(model.factory) or not (model.transformer_factory is None or callable(model.transformer_factory)):
        raise ValueError("a model needs a name and a callable factory")
    if isinstance(model.features, str) or not model.features or len(set(model.features)) < len(model.features):
        raise ValueError(f"{model.name}: features must be a list of different columns")
    if missing := [f for f in model.features if f not in columns]:
        raise ValueError(f"{model.name}: no such features: {missing}")
    if leaks := sorted(set(model.features) & outcomes):
        raise ValueError(f"{model.name}: outcomes and the time they become known are no features: {leaks}")
    if model.offset is not None and (model.offset not in columns or model.offset in outcomes):
        raise ValueError(f"{model.name}: the offset must be a column known at prediction time")


def _fresh(factory: Callable[[], object], seen: list, name: str) -> object:
    made = factory()
    if any(made is s for s in seen):
        raise ValueError(f"{name}: a factory must give a new object each time")
    if not callable(getattr(made, "fit", None)):
        raise TypeError(f"{name}: a factory's object needs fit()")
    seen.append(made)
    return made


def _predicted(train: DataFrame, valid: DataFrame, target: str, model: TrainableModel, seen: list, name: str) -> DataFrame:
    """valid with the column name: the prediction of a model fitted on train. What isn't a feature travels in one struct."""
    features = [F.col(f"`{f}`") for f in model.features]
    known = train.select(*features, F.col("__label").alias("label"))
    asked = valid.select(*features, F.struct(*[F.col(f"`{c}`") for c in valid.columns]).alias("__row"))
    if model.transformer_factory:
        change = _fresh(model.transformer_factory, seen, f"{model.name}'s transformer").fit(known)
        known, asked = change.transform(known), change.transform(asked)
    found = _fresh(model.factory, seen, model.name).fit(known).transform(asked)
    if missing := {"__row", "prediction"} - set(found.columns):
        raise ValueError(f"{model.name}: transform must keep its input's columns and add prediction; {sorted(missing)} are missing")
    return found.select("__row.*", F.col("prediction").cast("double").alias(name))


def walk_forward(data: DataFrame, target: str, time_column: str, models: list[TrainableModel], config: WalkForwardConfig | None = None, *, zone: str = "UTC", actual: str | None = None, progress: Callable[[dict], None] | None = None) -> tuple[DataFrame, list[dict]]:
    """(out-of-fold predictions cv_1, cv_2, ... with cv_fold, folds): every model is fitted anew on each fold's rows with a
    finite target that was known before validation starts.

    The predictions are written, so that each model is fitted and asked once. Folds whose validation dates overlap, folds
    with fewer than two labels and models that lose or repeat rows are errors."""
    config, columns = config or WalkForwardConfig(), list(data.columns)
    if reserved := [c for c in columns if c.startswith(("cv_", "__"))]:
        raise ValueError(f"names that begin with cv_ or __ are reserved: {reserved}")
    if missing := [c for c in (target, actual or target, time_column) if c not in columns]:
        raise ValueError(f"no such columns: {missing}")
    for m in models:
        _checked(m, columns, {target, actual or target, config.label_available_column} - {None})
    if len({m.name for m in models}) < len(models):
        raise ValueError("the models need different names")
    folds = plan_folds(data, time_column, config, zone=zone)
    if any(a["validation_end"] >= b["validation_start"] for a, b in zip(folds, folds[1:])):
        raise ValueError("validation dates of the folds overlap")
    total, done, parts, seen = len(folds) * len(models), 0, [], []
    label = num(target, data.schema[target].dataType)
    for fold in folds:
        train, valid = fold_rows(data, time_column, fold, config, zone)
        train = train.withColumn("__label", label).where("__label IS NOT NULL")
        fold["train_rows"], fold["validation_rows"] = train.count(), valid.count()
        if fold["train_rows"] < 2:
            raise ValueError(f"fold {fold['fold']} has fewer than two finite labels known before it")
        for i, m in enumerate(models, 1):
            if progress:
                progress({"stage": f"fold {fold['fold']}: {m.name}", "completed": done, "total": total})
            valid = _predicted(train, valid, target, m, seen, f"cv_{i}")
            done += 1
        parts.append(valid.withColumn("cv_fold", F.lit(fold["fold"])))
    out = followed(data.sparkSession, "out-of-fold predictions", lambda: written(reduce(DataFrame.unionByName, parts), "out-of-fold"), progress)
    n = {r["cv_fold"]: r["count"] for r in out.groupBy("cv_fold").count().collect()}  # a row for each fold
    if wrong := [f["fold"] for f in folds if n.get(f["fold"], 0) != f["validation_rows"]]:
        raise ValueError(f"models lost or repeated rows in folds {wrong}")
    return out, folds
