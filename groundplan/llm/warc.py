"""WARC archives: a writer for tables of pages and a reader that salvages damaged files.

``write`` stores one record per row. Records with equal payloads of at least
``SHARED_BYTES`` bytes share one response, that of the smallest page id; the others are
revisits without a payload. Only digests and ids are shuffled to find them. The list of shared payloads
is broadcast to the pages if its counted rows are at most ``BROADCAST_GROUPS``; beyond
it the pages are shuffled to it once. The files are plain WARC/1.0, written by
Spark's text sink, so they can lie in any store that Spark writes to. Pages are written
by classes of size, each with so many records a file that a file has at most
``FILE_BYTES`` of pages, or one page that is larger.

``read`` takes whole files, plain or with a gzip member per record. A record must have
a version line, headers with a length, its end marker, and the digests it names. After
a failed check the reader searches for the next gzip member or version line that
starts a valid record, goes on from there, and reports the bytes between as a gap.

Null html is an empty payload, a null url an empty one; a row without a page id is a
response that no revisit names, and is read back without one. Repeated rows become records of their
own (those with the response's id are responses), other columns do not
matter, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import shared_dir, table, written

SHARED_BYTES = 100
FILE_BYTES = 32 << 20
SMALL_BYTES, CLASS_STEP = 16 << 10, 16
CHUNK = 64 << 10
BROADCAST_GROUPS = 200_000
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes ``pages`` as WARC files into the folder ``path``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html.cast("binary"), 256).alias("digest")
    )
    groups = rows.where(F.col("n") >= SHARED_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    groups = written(groups, "shared-payloads")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    split = rows.join(groups, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("id") > F.col("first"))
    stem = lambda kind: F.concat(F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("n"), F.lit("\r\n"))
    response = F.concat(stem("response"), F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"), F.col("html"), F.lit("\r\n"))
    revisit = F.concat(stem("revisit"), F.lit("WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\nContent-Length: 0\r\n\r\n\r\n"))
    sized = split.select(F.when(again, revisit).otherwise(response).alias("value"), F.octet_length("url").alias("_url"), "n")
    largest = rows.agg(F.max(F.col("n") + F.octet_length("url"))).first()[0] or 0
    least, most = -1, SMALL_BYTES
    while least < largest:  # one class but for tables with large pages
        part = sized.where((F.col("n") + F.col("_url") > least) & (F.col("n") + F.col("_url") <= most)).select("value")
        part.write.mode("append").option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, FILE_BYTES // most)).text(path)
        least, most = most, most * CLASS_STEP


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The named fields after the version line at ``at`` and the place behind the blank line; None at the first line that is no field."""
    found, place = {}, data.find(b"\r\n", at) + 2
    while (stop := data.find(b"\r\n", place)) > place:
        name, colon, value = data[place:stop].partition(b":")
        if not colon:
            return None
        found[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        place = stop + 2
    return (found, place + 2) if stop == place else None


def record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, payload and end of the valid record that starts at ``at``, else None; nothing is copied before its end mark is seen."""
    if not VERSION.match(data, at):
        return None
    parsed = _headers(data, at)
    if parsed is None or not parsed[0].get("content-length", "").isdigit():
        return None
    headers, start = parsed
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    payload = data[start:end]
    named = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if named and headers.get("warc-type") != "revisit" and hashlib.sha256(payload).hexdigest() != named:
        return None
    return headers, payload, end + 4


def _member_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record of the gzip member at ``at``; the rest of the file is neither read nor copied."""
    unzip, parts, place, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not unzip.eof and place < len(data):
            parts.append(unzip.decompress(view[place : place + CHUNK]))
            place += CHUNK
    except zlib.error:
        return None
    if not unzip.eof:
        return None
    plain = b"".join(parts)
    found = record_at(plain, 0)
    return (found[0], found[1], min(place, len(data)) - len(unzip.unused_data)) if found and found[2] == len(plain) else None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """('record', start, length, headers, payload) of each valid record, ('gap', start, length, {}, b'') between them."""
    start = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
    at = gap = 0
    while at < len(data):
        found = _member_at(data, at) if data.startswith(MEMBER, at) else record_at(data, at)
        if found:
            if gap < at:
                yield "gap", gap, at - gap, {}, b""
            yield "record", at, found[2] - at, found[0], found[1]
            at = gap = found[2]
            continue
        after = start.search(data, at + 1)
        at = after.start() if after else len(data)
    if gap < len(data):
        yield "gap", gap, len(data) - gap, {}, b""


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema, payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for kind, at, size, headers, payload in salvage(content.as_py()):
                digest = hashlib.sha256(payload).hexdigest() if headers.get("warc-type") == "response" else headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                length = len(payload) if headers.get("warc-type") == "response" else int(headers.get("x-payload-length") or 0)
                rows.append((path, at, size, kind == "gap", headers.get("warc-type"), _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), length if headers else None, digest, _page(headers.get("warc-refers-to")), payload if payloads and headers else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, and one with ``quarantined`` true per byte gap between valid records."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [("archive", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("quarantined", T.BooleanType()), ("record_type", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in names])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_read, schema=to_arrow_schema(schema), payloads=payloads), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    # this job wrote the files itself, so a gap in them is a fault and no row to leave out
    lost = F.raise_error(F.concat(F.lit("quarantined bytes in "), "archive", F.lit(" at "), F.col("offset").cast("string"))).cast("boolean")
    return read(spark, path).where(F.when(F.col("quarantined"), lost).otherwise(True)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""
