"""Evaluation tables made of the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import Roles

EVENTS = Roles("actual", "prediction_a", "prediction_b", id_column="row_id", time_column="ts", entity_column="entity_id", tolerance=10.0)
LINEITEM = Roles("l_extendedprice", "prediction_a", "prediction_b", time_column="l_shipdate", entity_column="l_suppkey", tolerance=1000.0)
ORDERS = Roles("o_totalprice", "prediction_a", "prediction_b", id_column="o_orderkey", time_column="o_orderdate", entity_column="o_custkey", tolerance=1000.0)


def events_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events: the last value, and the mean of the last five, as predictions."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("row_id"), "ts", F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("segment"), F.col("value").alias("actual"),
        F.lag("value", 1).over(w).alias("prediction_a"), F.avg("value").over(w.rowsBetween(-5, -1)).alias("prediction_b"),
    )


def lineitem_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: quantity times the part's price, and the mean price by return flag, as predictions."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    means = items.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("prediction_b"))
    return items.join(parts, "l_partkey").withColumn("prediction_a", F.col("l_quantity") * F.col("p_retailprice")).join(means, "l_returnflag")


def orders_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: the mean price by status, and the customer's mean so far, as predictions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    means = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("prediction_a"))
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    return orders.withColumn("prediction_b", F.avg("o_totalprice").over(w)).join(means, "o_orderstatus")
