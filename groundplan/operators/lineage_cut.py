"""Cutting a plan's lineage between iterations, in a folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder, in sessions of one machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="groundplan-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found
