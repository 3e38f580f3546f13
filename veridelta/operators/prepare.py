"""Evaluation rows: roles applied, errors computed, invalid rows left out and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, local_time, num, utc_time
from ..plans.config import Roles


#: The roles that name columns.
ROLE_COLUMNS = ("actual", "reference", "candidate", "id_column", "time_column", "entity_column", "reference_offset", "candidate_offset")


def base_rows(data: DataFrame, roles: Roles) -> DataFrame:
    """All rows with the derived columns; NULL where a value is missing or not finite."""
    kinds = {f.name: f.dataType for f in data.schema}
    if len(kinds) < len(data.columns):
        raise ValueError("column names must be unique")
    if taken := [c for c in kinds if c.startswith("__")]:
        raise ValueError(f"names that begin with __ are reserved: {taken}")
    named = [roles.actual, roles.reference, roles.candidate, *[c for c in (roles.id_column, roles.time_column, roles.entity_column, roles.reference_offset, roles.candidate_offset) if c]]
    if missing := [c for c in named if c not in kinds]:
        raise ValueError(f"no such columns: {missing}")
    prediction = lambda c, o: num(c, kinds[c]) + num(o, kinds[o]) if o else num(c, kinds[c])
    out = data.withColumns({
        "__actual": num(roles.actual, kinds[roles.actual]),
        "__reference": finite(prediction(roles.reference, roles.reference_offset)),
        "__candidate": finite(prediction(roles.candidate, roles.candidate_offset)),
        "__time": utc_time(roles.time_column, kinds[roles.time_column], roles.timezone) if roles.time_column else F.lit(None).cast("timestamp"),
        "__entity": F.col(f"`{roles.entity_column}`") if roles.entity_column else F.lit(None).cast("string"),
    })
    error = lambda side: finite((F.col(f"__{side}") - F.col("__actual")) * F.lit(float(roles.error_scale)))
    local = local_time(F.col("__time"), roles.timezone)
    out = out.withColumns({"__error_reference": error("reference"), "__error_candidate": error("candidate"), "__date": F.date_format(local, "yyyy-MM-dd"), "__hour": F.hour(local)})
    return out.withColumns({"__ae_reference": F.abs("__error_reference"), "__ae_candidate": F.abs("__error_candidate")})


PAIRED = "__error_reference IS NOT NULL AND __error_candidate IS NOT NULL"
CANDIDATE = "__error_candidate IS NOT NULL"


def order_key(df: DataFrame, roles: Roles) -> list:
    """What stands for source order where ties are resolved: the id, or a hash of the row's own columns."""
    if roles.id_column:
        return [F.col(f"`{roles.id_column}`")]
    own = [F.col(f"`{c}`") for c in df.columns if not c.startswith("__")]
    return [F.xxhash64(*own)]


def coverage(base: DataFrame) -> DataFrame:
    """One row of counts over the whole population."""
    n = lambda cond: F.count_if(F.expr(cond)).alias
    counts = base.agg(
        F.count("*").alias("total"), n("__actual IS NOT NULL")("valid_target"), n(PAIRED)("paired"),
        n("__actual IS NOT NULL AND __reference IS NOT NULL")("reference_available"), n("__actual IS NOT NULL AND __candidate IS NOT NULL")("candidate_available"),
        n(f"{PAIRED} AND __time IS NULL")("missing_time"),
        n("__actual IS NOT NULL AND __reference IS NOT NULL AND __candidate IS NOT NULL AND (__error_reference IS NULL OR __error_candidate IS NULL)")("nonfinite_error_rows"),
        n("__error_reference IS NOT NULL")("reference_evaluable"), n(CANDIDATE)("candidate_evaluable"),
    )
    names = ["total", "valid_target", "paired", "reference_available", "candidate_available", "excluded", "missing_time", "nonfinite_error_rows", "reference_evaluable", "candidate_evaluable", "candidate_only_evaluable"]
    return counts.withColumn("excluded", F.col("total") - F.col("paired")).withColumn("candidate_only_evaluable", F.col("candidate_evaluable") - F.col("paired")).select(names)


def missingness(data: DataFrame) -> DataFrame:
    """(column, missing_n, missing_pct) of every column, from one pass."""
    names = [c for c in data.columns if not c.startswith("__")]
    one = data.agg(F.count("*").alias("total"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_n")) for i, c in enumerate(names)]))
    return one.select(rows.alias("r"), "total").select("r.column", "r.missing_n", F.try_divide(F.col("r.missing_n") * 100.0, "total").alias("missing_pct"))
