"""Rank statistics as columns; degenerate cases give null, never an error."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within the groups, ties sharing their mean rank."""
    w: WindowSpec = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation from sums; null for constant columns (``corr`` would raise)."""
    n, sx, sy = F.count(F.lit(1)).cast("double"), F.sum(x), F.sum(y)
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.try_divide(n * F.sum(x * y) - sx * sy, F.when((vx > 1e-12) & (vy > 1e-12), F.sqrt(vx) * F.sqrt(vy)))


def running_before(rows: DataFrame, by: list[str], value: str, n: str, parts: int = 64) -> DataFrame:
    """The rows (one per group and value, counting ``n``) with ``_before``: the count of all smaller values of the group.

    Groups are cut into ranges of value at approximate quantiles, so a large one
    is sorted in many tasks; the counts of the ranges before are carried in.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, F.lit([i / parts for i in range(1, parts)]), F.lit(10 * parts)).alias("_cuts"))
    cut = joined_null_safe(rows, cuts, by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = cut.groupBy(*by, "_part").agg(F.sum(n).alias("_sum"))
    carried = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined_null_safe(cut, carried, [*by, "_part"]).withColumn("_before", F.col("_carried") + inside).drop("_part", "_carried")


def joined_null_safe(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns in which null equals null."""
    a, b = rows.alias("a"), other.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on])
    return a.join(b, same).select(*[F.col(f"a.`{c}`") for c in rows.columns], *[F.col(f"b.`{c}`") for c in other.columns if c not in on])


def exact_percentiles(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation, from counts of distinct values: no task holds the values of a group."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    total = counted.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = joined_null_safe(running_before(counted, by, value, "_n"), total, by)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col(value)))

    out = []
    for name, p in ps.items():
        place = (F.col("_all") - 1) * F.lit(p)
        low = at(F.floor(place))
        out.append((low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(*by).agg(*out)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_p(z: Column) -> Column:
    """Two-sided tail of the normal distribution; Spark has no erfc, and only the few test rows need it."""

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2.0)))

    return tail(z)
