"""What the corpus operators share: table paths, the shared folder, checkpoints, folds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset a temporary folder is made, in sessions of one machine
    alone: on a cluster executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="groundplan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def written(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again; this cuts the lineage.

    Inside ``passing_tables`` it is deleted at the end unless it ``stays``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    passing = _PASSING.get()
    if passing is not None and not stays:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``written`` makes inside, at the end: what is read later has to be a table that stays."""
    passing: list[str] = []
    token = _PASSING.set(passing)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in passing:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        passing.clear()
        release(spark)


def held_out(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id's text leaves no remainder; a null id is held out too."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary")) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(folds) == 0, F.lit(True))
