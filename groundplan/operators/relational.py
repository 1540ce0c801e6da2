"""Relational operators that Spark lacks as one call: latest rows, modes, shares, top-k, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column]


def first_per_group(df: DataFrame, keys: Sequence[str], order: Order, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group; Spark drops the others before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def latest(df: DataFrame, key: str, date: str | None, tie: str) -> DataFrame:
    """The latest row per key: by ``date`` (null last), then ``tie``, both descending."""
    order = ([F.col(date).desc_nulls_last()] if date else []) + [F.col(tie).desc()]
    return first_per_group(df, [key], order)


def latest_values(df: DataFrame, key: str, date: str | None, ties: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of the latest row per key, as ``latest`` orders rows; an aggregate, so rows are combined before the shuffle."""
    rank = F.struct(*([date] if date else []), *ties)  # a null date ranks lowest
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("_last")).select(key, "_last.*")


def mode(df: DataFrame, keys: Sequence[str], value: str, tie: Order = (), nulls: bool = False) -> DataFrame:
    """The most frequent value per group; ties go by ``tie`` (the value by default). Counts are aggregated before they are ranked."""
    counted = (df if nulls else df.where(F.col(value).isNotNull())).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return first_per_group(counted, keys, [F.col("_n").desc(), *(tie or [F.col(value).asc()])]).drop("_n")


def with_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the sum of a column over all rows, one row of which is joined to all others."""
    return df.join(F.broadcast(df.agg(F.sum(value).alias(name))), how="cross")


def share_of_total(df: DataFrame, value: str, name: str, digits: int = 1) -> DataFrame:
    """``df`` with the percentage of the sum over all rows; null if the sum is 0."""
    share = F.round(F.col(value) / F.nullif(F.col("_total"), F.lit(0)) * 100, digits)
    return with_total(df, value, "_total").withColumn(name, share).drop("_total")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key. ``keep``: for a column, the value where both have a row, over ``old.*`` and ``new.*``."""
    columns = old.columns
    left, right = old.alias("old"), new.alias("new")
    match = reduce(lambda a, b: a & b, (F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys))
    joined = left.join(right, match, "full_outer")
    has_new, has_old = F.col(f"new.{keys[0]}").isNotNull(), F.col(f"old.{keys[0]}").isNotNull()
    picked = []
    for c in columns:
        fresh = F.col(f"new.{c}") if c in new.columns else F.col(f"old.{c}")
        both = (keep or {}).get(c, fresh)
        picked.append(F.when(has_new & has_old, both).when(has_new, fresh).otherwise(F.col(f"old.{c}")).alias(c))
    return joined.select(*picked)


def delete_stale(df: DataFrame, scope: Sequence[str], submission: str, current: DataFrame) -> DataFrame:
    """Drops rows of a scope named in ``current`` whose submission is another than there."""
    now = current.select(*scope, F.col(submission).alias("_now"))
    joined = df.join(now, list(scope), "left")
    return joined.where(F.col("_now").isNull() | (F.col(submission) == F.col("_now"))).drop("_now")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def ranked_lookup(left: DataFrame, strategies: Sequence[tuple[int, DataFrame]], key: str, order: Order) -> DataFrame:
    """Joins ``left`` with the best candidate of several strategies; ``strategies``: (rank, candidates with ``key``)."""
    candidates = reduce(DataFrame.unionByName, (c.withColumn("strategy", F.lit(rank)) for rank, c in strategies))
    return left.join(first_per_group(candidates, [key], [F.col("strategy"), *order]), key, "left")


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """Filters by the arguments that are set: equality, or membership for lists."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def rag_filter(df: DataFrame, wanted: str | None, column: str = "rag_status") -> DataFrame:
    """RED, AMBER, GREEN, ``unassessed`` for null; anything else keeps all rows."""
    if wanted in ("RED", "AMBER", "GREEN"):
        return df.where(F.col(column) == wanted)
    return df.where(F.col(column).isNull()) if wanted == "unassessed" else df


def clamp(n: int, most: int, least: int = 1) -> int:
    return max(least, min(n, most))
