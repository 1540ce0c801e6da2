"""Background enrichment: rows that arrive get their reference data, in commits of bounded size.

Each micro-batch is committed in parts of about ``rows`` rows, each under its batch's
number and its own. What is committed is visible at once, so ``status`` shows progress
while the stream runs. After a crash the same batch comes again; parts that are in the
table already are not written again, so no row is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundplan.operators.lineage_cut import cut
from groundplan.sources.snapshots import SnapshotTable, Staged

#: What ``enriched`` adds.
ADDED = "uprn string, enrichment_status string"


def _address(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[,\s]+", " "))


def _postcode(c: str) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


def references(rows: DataFrame) -> DataFrame:
    """(_postcode, _address, uprn) of reference rows (postcode, address, uprn), one for each address."""
    keyed = rows.where("uprn is not null").select(_postcode("postcode").alias("_postcode"), _address("address").alias("_address"), "uprn")
    return keyed.where("_postcode is not null and _address is not null").groupBy("_postcode", "_address").agg(F.min("uprn").alias("uprn"))


def enriched(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (postcode, address, ...) with the ``uprn`` of their address and ``enriched`` or ``failed``."""
    joined = rows.withColumns({"_postcode": _postcode("postcode"), "_address": _address("address")}).join(known, ["_postcode", "_address"], "left")
    return joined.withColumn("enrichment_status", F.when(F.col("uprn").isNotNull(), "enriched").otherwise("failed")).drop("_postcode", "_address")


def enrich(stream: DataFrame, known: DataFrame, table: SnapshotTable, key: str, checkpoint: str, rows: int = 5_000, writer: str = "enrichment") -> StreamingQuery:
    """Enriches a stream of rows into ``table``; stop and start it with the same ``checkpoint`` and ``writer``.

    What is ``known`` is computed once, and a batch is read, joined and written once,
    however many commits it takes.
    """
    known = cut(known)

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            parts = max(1, -(-batch.count() // rows))
            left = [k for k in range(parts) if not table.has(writer, [number, k])]
            if not left:
                return
            dealt = batch.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).where(F.col("_part") >= left[0])
            staged = table.stage(enriched(dealt, known).repartition(len(left), "_part"), "_part")
            for k in left:
                table.append(staged.get(k, Staged("", 0)), writer, [number, k], {"part": k + 1, "parts": parts})
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(table: SnapshotTable) -> DataFrame:
    """Rows by ``enrichment_status`` in what is committed so far."""
    return table.read().groupBy("enrichment_status").agg(F.count("*").alias("n"))


def progress(table: SnapshotTable) -> dict[str, int]:
    """Commits and rows so far, and the parts of the last batch that are done and in all; from the log alone."""
    last = table.last()
    return {"commits": last["version"] + 1, "rows": last["rows"], "part": last.get("part", 0), "parts": last.get("parts", 0)}
