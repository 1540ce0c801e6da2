"""Arriving uploads as streams: routing, commits, replacement, aggregates kept by deltas, windows over event time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundplan.sources.readers import key_parts
from groundplan.sources.snapshots import SnapshotTable

SIDE_CARS = ("manifest.json", "metadata.json", "features.json", "extraction.json")


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """New objects under ``path`` with their key's parts; side-cars, which the workers write, are no arrivals."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    keyed = files.withColumns(key_parts(F.col("path")))
    return keyed.where(F.col("file").isNotNull() & ~F.col("file").isin(*SIDE_CARS)).select("path", "ha_id", "dataset", "submission_id", "file", "modificationTime")


def events(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """The event table as a stream; ``ts`` is cast, as watermarks need a zoned timestamp."""
    schema = spark.read.parquet(f"{path}/{files}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def into_table(stream: DataFrame, table: SnapshotTable, writer: str, checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Commits each micro-batch to ``table`` under its number, so that a batch replayed after a failure changes nothing.

    Upserts are reads: ``table.current(keys, order)`` gives each key's row of the highest
    order, however late it came, and ``table.compact`` keeps only those.
    """
    writer_ = stream.writeStream.foreachBatch(lambda batch, number: table.append(batch, writer, [number])).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer_.trigger(availableNow=True) if once else writer_).start()


def tumbling(df: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by window and key; with ``slide`` the windows overlap."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = df.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    grouped = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once_per_key(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Re-uploads within the watermark are dropped; state is bounded by it."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and gives its rows, a Parquet table beside the checkpoint."""
    spark, target = stream.sparkSession, f"{checkpoint}-{name}"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(target)  # for a stream without a batch
    query = stream.writeStream.format("parquet").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def maintained(stream: DataFrame, keys: list[str], sums: dict[str, Column], highest: dict[str, Column], table: SnapshotTable, writer: str, checkpoint: str) -> StreamingQuery:
    """What row triggers keep up to date, by deltas: each batch adds its own sums and maxima by key, and reads nothing else.

    ``sums`` may be negative, for rows that are taken back; ``highest`` cannot be taken
    back. ``totals`` reads the table; ``fold`` shrinks it to a row a key.
    """

    def put(batch: DataFrame, number: int) -> None:
        deltas = batch.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max(c).alias(n) for n, c in highest.items()))
        table.append(deltas, writer, [number])

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(deltas: DataFrame, keys: list[str], sums: Iterable[str], highest: Iterable[str]) -> DataFrame:
    """The values by key of a table of deltas."""
    return deltas.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sums), *(F.max(n).alias(n) for n in highest))


def fold(table: SnapshotTable, keys: list[str], sums: Iterable[str], highest: Iterable[str]) -> int:
    """Replaces the deltas by their totals; a conflict, and no change, if a batch is committed meanwhile."""
    return table.replace(lambda deltas: totals(deltas, keys, sums, highest))
