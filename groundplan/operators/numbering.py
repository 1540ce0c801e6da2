"""Running numbers and previous values over long groups, by ranges and prefix sums.

A window over a group runs in one task. Here the order is cut into ``RANGES`` ranges of
about equal size by approximate quantiles; each range of a group is a window of its own,
and what lies before it comes from a table of one row for each range and group. So a
group of all rows takes as many tasks as there are ranges. Equal order values share a
range, and their order among each other is open, as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def ranged(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with the number of its range of ``order``, a number or date, as ``_range``; no plan over its rows if it has none."""
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(order, F.array(*map(F.lit, shares)), F.lit(100 * ranges)).alias("e"), F.count("*").alias("n")).first()
    if not found.n:
        return df.where(F.lit(False)).withColumn("_range", F.lit(0))
    edges = found.e or []
    cuts = F.array(*(F.lit(e) for e in sorted(set(edges)))) if edges else F.array().cast("array<int>")
    return df.withColumn("_range", F.size(F.filter(cuts, lambda e: e < F.col(order))) if edges else F.lit(0))


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``name``, the number of each row in its group from 1, by ``order``."""
    rows = ranged(df, order, ranges)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    offsets = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(offsets, same).select(*df.columns, (F.col("_before") + F.col("_nth")).alias(name))


def previous(df: DataFrame, keys: Sequence[str], order: str, name: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``name``, the order value of the row before in its group; null for the first."""
    rows = ranged(df, order, ranges)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "_range").agg(F.max(order).alias("_last"))
    ends = last.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_of"), F.max("_last").over(before).alias("_end"))
    inside = rows.withColumn("_prev", F.lag(order).over(Window.partitionBy(*keys, "_range").orderBy(order)))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(ends, same).select(*df.columns, F.coalesce("_prev", "_end").alias(name))
