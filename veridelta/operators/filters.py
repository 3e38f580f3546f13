"""Predicates on one column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import num


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def condition(df: DataFrame, column: str, *, minimum=None, maximum=None, values=None, include_missing: bool = False, minimum_inclusive: bool = True, maximum_inclusive: bool = True, match: str = "exact", case_sensitive: bool = True) -> Column:
    """A range of numbers, or text that equals, contains, starts or ends with any of values; without either, not missing.

    Ignoring case takes Unicode case folding: for ASCII values and ASCII text that is lower(), inside the JVM; other
    text goes through Python."""
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    if values is not None and (minimum is not None or maximum is not None):
        raise ValueError("give values or bounds, not both")
    if match not in ("exact", "contains", "starts_with", "ends_with"):
        raise ValueError("match must be exact, contains, starts_with or ends_with")
    c = F.col(f"`{column}`")
    if minimum is not None or maximum is not None:
        x, keep = num(column, df.schema[column].dataType), F.lit(True)
        if minimum is not None:
            keep &= x >= float(minimum) if minimum_inclusive else x > float(minimum)
        if maximum is not None:
            keep &= x <= float(maximum) if maximum_inclusive else x < float(maximum)
        keep &= x.isNotNull()
    elif values is not None:
        text, wanted = c.cast("string"), [str(v) for v in ([values] if isinstance(values, str) else values)]
        if not case_sensitive:
            text = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_casefold(text))
            wanted = [w.casefold() for w in wanted]
        test = {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}.get(match)
        keep = F.lit(False)
        for w in wanted if test else []:
            keep |= test(w)
        keep = (text.isin(wanted) if wanted else F.lit(False)) if not test else keep
        keep = F.coalesce(keep, F.lit(False))
    else:
        keep = c.isNotNull()
    return F.coalesce(keep, F.lit(False)) | c.isNull() if include_missing else keep
