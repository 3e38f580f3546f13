"""Tables in, and predictions joined to them."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_data(source: DataFrame | str, *, spark: SparkSession | None = None, string_columns: list[str] | str | None = None) -> DataFrame:
    """A table from a DataFrame, .csv or .parquet (.parque, .pq). string_columns, or all of them, of a CSV stay text, so that 001 is not 1."""
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.active()
    suffix = PurePosixPath(str(source)).suffix.lower()
    if suffix in (".parquet", ".parque", ".pq"):
        return spark.read.parquet(str(source))
    if suffix != ".csv":
        raise ValueError(f"unsupported file type {suffix!r}: use .csv or .parquet")
    reader = spark.read.option("header", True)
    if string_columns == "all":
        return reader.csv(str(source))
    found = reader.option("inferSchema", True).csv(str(source))
    keep = set(string_columns or [])
    if keep - set(found.columns):
        raise ValueError(f"no such columns: {sorted(keep - set(found.columns))}")
    return reader.schema(StructType([StructField(f.name, StringType()) if f.name in keep else f for f in found.schema])).csv(str(source)) if keep else found


def check_key(df: DataFrame, keys: list[str], what: str) -> None:
    """Fails on null or repeated keys; the counting is one job whose result is a row at most."""
    missing = set(keys) - set(df.columns)
    if missing:
        raise ValueError(f"{what} lacks {sorted(missing)}")
    bad = df.groupBy(*keys).count().where(" OR ".join([f"`{k}` IS NULL" for k in keys] + ["count > 1"])).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {keys} must be unique and not null, found {bad[0].asDict()}")


def attach_predictions(data: DataFrame, predictions: DataFrame, *, on: str, columns: dict[str, str] | list[str] | None = None, check: bool = True) -> DataFrame:
    """data with the predictions' columns (renamed by a dict) by a 1:1 left join on a key that is unique in both."""
    names = columns if isinstance(columns, dict) else {c: c for c in (columns or [c for c in predictions.columns if c != on])}
    if missing := set(names) - set(predictions.columns):
        raise ValueError(f"predictions lack {sorted(missing)}")
    if clash := set(names.values()) & set(data.columns):
        raise ValueError(f"data has columns {sorted(clash)} already")
    if check:
        check_key(data, [on], "data")
        check_key(predictions, [on], "predictions")
    return data.join(predictions.select(on, *[F.col(f"`{a}`").alias(b) for a, b in names.items()]), on, "left")


def from_long_predictions(data: DataFrame, predictions: DataFrame, *, on: str = "row_id", model: str = "model", value: str = "prediction", stage_column: str | None = "stage", stage: str | None = None, models: list[str] | None = None, check: bool = True) -> DataFrame:
    """data with one column per model of (record, model, stage, prediction) rows. Where there are several stages, one must be named.

    models: the models' names; without it they are read from the predictions."""
    if stage_column and stage_column in predictions.columns:
        if stage is None:
            found = predictions.select(stage_column).distinct().limit(2).collect()
            if len(found) > 1 or any(r[0] is None for r in found):
                raise ValueError("name the stage: there are several, or null ones")
        else:
            predictions = predictions.where(F.col(stage_column) == stage)
    elif stage is not None:
        raise ValueError("there is no stage column")
    if check:
        check_key(predictions, [on, model], "predictions")
    names = models or sorted(r[0] for r in predictions.select(model).distinct().collect())
    wide = predictions.groupBy(on).pivot(model, names).agg(F.first(value))
    return attach_predictions(data, wide, on=on, columns=names, check=check)


def read_config(path: str) -> dict:
    """A run's JSON settings; 'inf' and '-inf' are edges of bins."""
    with open(path) as f:
        return json.load(f)


def make_demo(spark: SparkSession, n: int = 1200, seed: int = 2026) -> DataFrame:
    """A synthetic evaluation table: 12 entities, a row every 15 minutes, a candidate that improves on the reference but for segment A's bias."""
    i = F.col("id")
    df = spark.range(n).select(
        i.alias("row_id"), F.format_string("entity_%02d", i % 12).alias("entity_id"), F.randn(seed).alias("actual"),
        (F.randn(seed + 1) * 0.5).alias("e"), (F.randn(seed + 2) * 0.1).alias("noise"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (i % 3 + 1).cast("int")).alias("segment"),
        F.when(i % 2 == 0, "X").otherwise("Y").alias("category"), (i % 10 + 0.5).alias("measure_1"), (i % 5 + 1).alias("measure_2"),
        F.timestamp_micros(F.lit(1767225600000000) + i * 900_000_000).alias("time"),
    )
    shift = F.when(F.col("segment") == "A", 0.05).otherwise(0.0)
    return df.select("row_id", "entity_id", "actual", (F.col("actual") + F.col("e")).alias("reference_prediction"), (F.col("actual") + F.col("e") * 0.8 + F.col("noise") + shift).alias("candidate_prediction"), "segment", "category", "measure_1", "measure_2", "time")
