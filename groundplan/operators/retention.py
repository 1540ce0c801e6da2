"""Retention of personal data: what is over its time, its deletion with an audit, and the export of one subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(rows: DataFrame, policies: DataFrame, as_of: Column) -> DataFrame:
    """``rows`` (data_type, created_on, ...) with ``over``: whether ``policies`` (data_type, retention_days, auto_delete) let them go; rows without a policy stay."""
    known = policies.select("data_type", "retention_days", "auto_delete")
    joined = rows.join(known, "data_type", "left")
    over = F.col("auto_delete") & (as_of > F.date_add("created_on", F.col("retention_days")))
    return joined.withColumn("over", F.coalesce(over, F.lit(False))).drop("retention_days", "auto_delete")


def enforce(rows: DataFrame, policies: DataFrame, key: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and an audit row (data_type, key, created_on, deleted_on) for each that goes."""
    marked = expired(rows, policies, as_of)
    audit = marked.where("over").select("data_type", key, "created_on", as_of.alias("deleted_on"))
    return marked.where("not over").drop("over"), audit


def exported(rows: DataFrame, subject: str, consent: str) -> DataFrame:
    """A JSON document per subject of all its rows for which there is a consent, in the order of their fields."""
    given = rows.where(F.col(consent))
    return given.groupBy(subject).agg(F.count("*").alias("records"), F.to_json(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c not in (subject, consent)))))).alias("document"))
