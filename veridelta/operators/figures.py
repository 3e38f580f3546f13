"""The tables behind the figures: grids, histograms, quantiles against the normal, evenly spaced points, remainders."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.robust import piece_between
from ..plans.config import positive
from ..sources.tables import written
from .quantiles import quantiles
from .temporal import numbered

#: Points of a scatter, of a quantile plot, and most bins of a histogram.
POINTS, QQ_POINTS, HISTOGRAM_BINS = 3000, 500, 50
#: Columns of a grid; more labels are an error, as a grid is for reading.
GRID_COLUMNS = 500


def label_grid(table: DataFrame, value: str, row: str = "x", column: str = "y") -> DataFrame:
    """A row for each label of row, a column for each of column, and value in the cells; absent cells are NULL.

    The labels are counted before the pivot, in one job of at most GRID_COLUMNS + 1 rows."""
    labels = sorted(r[0] for r in table.select(F.col(column).cast("string").alias("l")).distinct().limit(GRID_COLUMNS + 1).collect())
    if len(labels) > GRID_COLUMNS:
        raise ValueError(f"more than {GRID_COLUMNS} columns; take fewer labels")
    if row in labels:
        raise ValueError(f"a label has the row column's name {row!r}")
    return table.withColumn(column, F.col(column).cast("string")).groupBy(row).pivot(column, labels).agg(F.first(value))


def histogram(rows: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, left, right, n) of equal-width bins over all finite values, empty ones too; the last one takes its right edge in.

    As many bins as the root of the rows, HISTOGRAM_BINS at most, unless given; one pass for the range, one for the counts."""
    if bins is not None:
        positive("bins", bins)
    thin = written(rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), "histogram")
    n, low, high = thin.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return thin.sparkSession.createDataFrame([], "bin int, left double, right double, n long")
    bins = bins or min(HISTOGRAM_BINS, max(1, int(n**0.5)))
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    # where the span itself is no number, a quarter of everything has the same bins
    edges = np.linspace(low, high, bins + 1) if np.isfinite(high - low) else np.linspace(low / 4, high / 4, bins + 1) * 4
    # the place by division may be off by a rounding error at an edge: the edges decide
    guess = piece_between(F.col("v"), F.lit(low), F.lit(high), bins)
    at = F.array(*[F.lit(float(e)) for e in edges])
    left, right = F.element_at(at, F.col("g") + 1), F.element_at(at, F.col("g") + 2)
    place = F.col("g") - (F.col("v") < left).cast("int") + ((F.col("v") >= right) & (F.col("g") < bins - 1)).cast("int")
    counts = thin.withColumn("g", guess).groupBy(place.alias("bin")).agg(F.count("*").alias("k"))
    grid = thin.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(bins)], "bin int, left double, right double")
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", "left", "right", F.coalesce("k", F.lit(0)).alias("n"))  # a row for each bin


def normal_quantiles(rows: DataFrame, column: str, points: int = QQ_POINTS) -> DataFrame:
    """(probability, theoretical, observed, reference): exact quantiles of all values against the standard normal's, and
    the line through the median with the slope of the quartiles."""
    positive("points", points)
    thin = written(rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), "normal")
    n = min(thin.count(), points)
    if not n:
        return thin.sparkSession.createDataFrame([], "probability double, theoretical double, observed double, reference double")
    levels = [(i + 0.5) / n for i in range(n)]
    found = quantiles(thin, [], {"observed": ("v", levels), "quarters": ("v", [0.25, 0.5, 0.75])})
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in levels])
    line = found.select("quarters", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in levels]).alias("probability"), normal.alias("theoretical"), F.col("observed"))).alias("z")).select("quarters", "z.*")
    slope = (F.col("quarters")[2] - F.col("quarters")[0]) / F.lit(2 * NormalDist().inv_cdf(0.75))
    return line.select("probability", "theoretical", "observed", (F.col("quarters")[1] + slope * F.col("theoretical")).alias("reference"))


def even_points(rows: DataFrame, order: list[str], columns: list[str], limit: int = POINTS) -> DataFrame:
    """(position, *columns) of at most limit rows, evenly spaced in a unique order, with both ends."""
    positive("limit", limit)
    placed = numbered(rows.select(*dict.fromkeys([*order, *columns])), order, "position")
    n = placed.count()
    wanted = sorted({int(x) for x in np.linspace(0, n - 1, min(n, limit), dtype=int)}) if n else []
    chosen = rows.sparkSession.createDataFrame([(x,) for x in wanted], "position long")
    return placed.join(F.broadcast(chosen), "position").select("position", *columns)  # at most limit rows


def with_remainder(local: DataFrame, key: str, top_n: int = 15) -> DataFrame:
    """Each explained row's top_n features by the size of their contributions, and one row for the sum of the others, if any."""
    positive("top_n", top_n)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("shap_value_scaled")), "feature"))  # a row's features
    ranked = local.withColumn("rank", rank)
    shown = ranked.where(F.col("rank") <= top_n).select(key, "rank", "feature", F.col("feature_value").cast("string").alias("feature_value"), "shap_value_scaled")
    rest = ranked.where(F.col("rank") > top_n).groupBy(key).agg(F.lit(top_n + 1).alias("rank"), F.format_string("Other %d features", F.count("*")).alias("feature"), F.lit("").alias("feature_value"), F.sum("shap_value_scaled").alias("shap_value_scaled"))
    return shown.unionByName(rest)
