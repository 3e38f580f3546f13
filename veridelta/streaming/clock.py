"""The fixed-clock error bins on a stream: an extension of the batch tables, with the same bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prepare import PAIRED, base_rows
from ..plans.config import Roles, bin_micros


def streaming_bins(stream: DataFrame, roles: Roles, frequency: str = "1h", watermark: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Paired errors by epoch-anchored, left-closed bins: (time, time_end, keys, n, reference_mae, candidate_mae, bias).

    Rows later than the watermark are dropped by Spark, and a bin is final when the watermark has passed it. Quantiles
    and distinct counts, which would hold every row, are left to the batch tables."""
    if not roles.time_column:
        raise ValueError("map the time column first")
    rows = base_rows(stream, roles).where(PAIRED).where("__time IS NOT NULL").withWatermark("__time", watermark)
    micros = bin_micros(frequency)
    window = F.window("__time", f"{micros} microseconds")
    out = rows.groupBy(window, *(keys or [])).agg(F.count("*").alias("n"), F.avg("__ae_reference").alias("reference_mae"), F.avg("__ae_candidate").alias("candidate_mae"), F.avg("__error_candidate").alias("candidate_bias"))
    return out.select(F.col("window.start").alias("time"), F.col("window.end").alias("time_end"), *(keys or []), "n", "reference_mae", "candidate_mae", "candidate_bias")
