"""Exact quantiles of groups of any size: counts by value range, then only the ranges that hold the wanted ranks.

A first pass counts each group's values by ranges of a 2048th of an octave, so what is shuffled is counts. Running
counts over a group's ranges place every wanted rank in one of them. Ranges that still hold many rows are cut again
between their own least and largest value; what is left are few values, counted one by one. No task holds a group and
no aggregate's buffer its values; equal values, however many, are one row with a count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.robust import piece_between
from ..sources.tables import written

OCTAVE, PIECES = 2048, 4096
#: Rows of a range that are counted value by value.
FEW = 1_000_000


def _range(v: Column) -> Column:
    """A whole number that never falls as v grows."""
    place = lambda x: F.floor((F.log2(x) + 1080) * OCTAVE) + 1
    return F.when(v > 0, place(v)).when(v < 0, -place(-v)).otherwise(0).cast("long")


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """keys and, for each name -> (column, levels) of wanted, an array of the column's quantiles within each group.

    Linear interpolation between the two nearest ranks, as numpy and SQL's quantile_cont have it; NULL values don't
    count, a group without values has no row, and a column without values in its group a NULL. rows are read two or more times: give a
    written table."""
    if taken := set(keys) & {"c", "v", "b", "n", "lo", "hi", "k", "i", "r", "z", "side", "part", "before", "total"}:
        raise ValueError(f"keys of other names than {sorted(taken)} are needed")
    names = list(wanted)
    levels = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(p_list)]) for _, p_list in wanted.values()])
    value = lambda c: F.col(c).cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), value(column).alias("v")) for i, (column, _) in enumerate(wanted.values())]))
    long = rows.select(*keys, each.alias("z")).select(*keys, F.col("z.c").alias("c"), F.col("z.v").alias("v")).where("v IS NOT NULL")
    group = [*keys, "c"]
    whole = W.partitionBy(*group)
    # no group has more than FEW rows if all have not: then values are counted at once
    direct = rows.count() <= FEW
    cells = long.groupBy(*group, (F.col("v") if direct else _range(F.col("v"))).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells = cells.withColumns({"before": F.sum("n").over(whole.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"), "total": F.sum("n").over(whole)})
    at = lambda p: p * (F.col("total") - 1)
    here = F.filter(F.element_at(levels, F.col("c") + 1), lambda z: (F.ceil(at(z["p"])) >= F.col("before")) & (F.floor(at(z["p"])) < F.col("before") + F.col("n")))
    ranks = F.flatten(F.transform(here, lambda z: F.array(*[F.struct(z["i"].alias("i"), F.lit(s).alias("side"), f(at(z["p"])).cast("long").alias("k"), (at(z["p"]) - F.floor(at(z["p"]))).alias("part")) for s, f in ((0, F.floor), (1, F.ceil))])))
    inside = F.filter(ranks, lambda r: (r["k"] >= F.col("before")) & (r["k"] < F.col("before") + F.col("n")))
    state = cells.select(*group, "n", "lo", "hi", "before", F.explode(inside).alias("r")).select(*group, "r.i", "r.side", "r.part", (F.col("r.k") - F.col("before")).alias("k"), "n", "lo", "hi")
    done = [state.withColumn("v", F.col("lo"))] if direct else []
    while not direct:
        # a row for each group, column, level and side; small enough to broadcast only if its files are
        state = written(state, "ranks")
        known = (F.col("lo") == F.col("hi")) | (F.col("k") == 0) | (F.col("k") == F.col("n") - 1)
        done.append(state.where(known).withColumn("v", F.when(F.col("k") == 0, F.col("lo")).otherwise(F.col("hi"))))
        left = state.where(~known)
        most = left.agg(F.max("n")).first()[0]
        if most is None:
            break
        cut = piece_between(F.col("v"), F.col("lo"), F.col("hi"), PIECES)
        if most <= FEW:
            found = _narrowed(long, left, group, F.col("v"))
            done.append(found.withColumn("v", F.col("lo")))
            break
        state = _narrowed(long, left, group, cut)
    found = reduce(lambda a, b: a.unionByName(b), [d.select(*group, "i", "side", "part", "v") for d in done])
    pairs = found.groupBy(*group, "i").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"), F.max("part").alias("part"))
    step = F.col("b") - F.col("a")
    # between values of opposite sign and extreme size the step itself is no number
    between = F.when(F.abs(step) < float("inf"), F.col("a") + step * F.col("part")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    pairs = pairs.withColumn("q", between)
    arrays = []
    for i, name in enumerate(names):
        mine = F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == i, F.struct("i", "q")))), lambda z: z["q"])  # a row for each level
        arrays.append(F.when(F.count_if(F.col("c") == i) > 0, mine).alias(name))
    return pairs.groupBy(*keys).agg(*arrays)


def _narrowed(long: DataFrame, left: DataFrame, group: list[str], cell: Column) -> DataFrame:
    """The ranks that aren't known yet, each in its cell of the range it was in."""
    spans = left.select(*group, "lo", "hi").distinct()
    inside = long.alias("a").join(spans.alias("s"), _same("a", "s", group) & F.col("a.v").between(F.col("s.lo"), F.col("s.hi"))).select("a.*", "s.lo", "s.hi").withColumn("b", cell)
    cells = inside.groupBy(*group, "lo", "b").agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("largest"))
    cells = cells.withColumn("before", F.sum("m").over(W.partitionBy(*group, "lo").orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("m"))
    both = left.alias("l").join(cells.alias("x"), _same("l", "x", [*group, "lo"]) & (F.col("l.k") >= F.col("x.before")) & (F.col("l.k") < F.col("x.before") + F.col("x.m")))
    return both.select(*[f"l.{g}" for g in group], "l.i", "l.side", "l.part", (F.col("l.k") - F.col("x.before")).alias("k"), F.col("x.m").alias("n"), F.col("x.least").alias("lo"), F.col("x.largest").alias("hi"))


def with_quantiles(groups: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """groups (a row for each group of keys; the only one, without keys) with quantiles' arrays."""
    found = quantiles(rows, keys, wanted)
    if not keys:
        return groups.join(F.broadcast(found), F.lit(True), "left")  # one row each
    found = found.withColumnsRenamed({k: f"__q_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__q_{k}")) for k in keys])
    return groups.join(found, same, "left").drop(*[f"__q_{k}" for k in keys])
