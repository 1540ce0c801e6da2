"""Media columns: payloads stored as media, found again by their signatures.

``wave`` stores bytes losslessly as the samples of an 8-bit mono WAV, with built-in
functions. ``sniff`` reads any binary media column: one Aho-Corasick pass locates all
magic bytes, a validator of each format confirms structure and length, the first
confirmed hit at offset 0 corrects the declared type, and confirmed hits further on are
carved as embedded media. A magic string that no validator confirms means nothing.
Trailers that end a format are located once per value, so the work of a value is in
proportion to its length however many magic strings it holds.

Null text is empty text; a null media value has no type, no samples and null digests.
Repeated rows get equal results, other columns do not matter, an empty table gives an
empty result. Values are held one at a time beside their Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import table

ALIGN = 64
RATE = 8000
TAIL = 64
CHUNK = 64 << 10
UNKNOWN = "application/octet-stream"
DECLARED = ("audio/wav", UNKNOWN, "text/plain", "image/png")


def padded(data: Column) -> Column:
    """Bytes with zeros appended up to a positive multiple of ALIGN."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / ALIGN)).cast("int") * ALIGN
    return F.rpad(data, size, F.lit(bytearray(b"\0")))


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def wave(payload: Column) -> Column:
    """An 8-bit mono WAV whose samples are the payload."""
    n = F.octet_length(payload).cast("long")
    form = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data")
    return F.concat(F.lit(bytearray(b"RIFF")), _le32(n + 36), F.lit(bytearray(b"WAVE" + form)), _le32(n), payload)


class _Value:
    """A media value with the places of format trailers in it, each found once."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.found[mark]

    def first(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1."""
        places = self.places(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def last(self, mark: bytes, at: int, end: int) -> int:
        """The last place of ``mark`` from ``at`` on and before ``end``, or -1."""
        places = self.places(mark)
        k = bisect_left(places, end) - 1
        return places[k] if k >= 0 and places[k] >= at else -1


# Validators: the length of the medium that starts at ``at``, or 0.


def _riff(value: _Value, at: int) -> int:
    data = value.data
    if len(data) - at < 20:
        return 0
    size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if size > len(data) - at or data[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    place = at + 12
    while place + 8 <= at + size:
        place += 8 + (n := int.from_bytes(data[place + 4 : place + 8], "little")) + n % 2
    return size if place == at + size else 0


def _png(value: _Value, at: int) -> int:
    data, place, view = value.data, at + 8, memoryview(value.data)
    if data[place : place + 8] != b"\0\0\0\rIHDR":  # always the first chunk, of 13 bytes
        return 0
    stop = value.last(b"IEND", place, len(data)) + 8
    while place + 12 <= len(data):
        n = int.from_bytes(data[place : place + 4], "big")
        end = place + 12 + n
        if end > stop or zlib.crc32(view[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return 0
        if data[place + 4 : place + 8] == b"IEND":
            return end - at
        place = end
    return 0


def _gif(value: _Value, at: int) -> int:
    data = value.data
    if len(data) - at < 14:
        return 0
    flags = data[at + 10]
    place = at + 13 + (3 << (flags % 8 + 1) if flags & 128 else 0)
    while place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return place + 1 - at
        if kind == 0x21:
            place += 2
        elif kind == 0x2C and place + 10 <= len(data):
            local = data[place + 9]
            place += 11 + (3 << (local % 8 + 1) if local & 128 else 0)
        else:
            return 0
        while place < len(data) and data[place]:
            place += data[place] + 1
        place += 1
    return 0


def _jpeg(value: _Value, at: int) -> int:
    data, place = value.data, at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind = data[place + 1]
        if kind == 0xDA:
            end = value.first(b"\xff\xd9", place)
            return end + 2 - at if end > 0 else 0
        if not 0xC0 <= kind <= 0xFE:
            return 0
        place += 2 + int.from_bytes(data[place + 2 : place + 4], "big")
    return 0


def _bmp(value: _Value, at: int) -> int:
    data = value.data
    if len(data) - at < 26:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", data, at + 2)
    return size if not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(data) - at else 0


def _gzip(value: _Value, at: int) -> int:
    data = value.data
    if len(data) - at < 18 or data[at + 3] & 0xE0:
        return 0
    unzip, place, view = zlib.decompressobj(31), at, memoryview(data)
    try:
        while not unzip.eof and place < len(data):
            unzip.decompress(view[place : place + CHUNK])
            place += CHUNK
    except zlib.error:
        return 0
    return min(place, len(data)) - at - len(unzip.unused_data) if unzip.eof else 0


def _pdf(value: _Value, at: int) -> int:
    """Up to the last end mark before the next file's header, as a file may have been extended."""
    following = value.first(b"%PDF-", at + 1)
    end = value.last(b"%%EOF", at, following if following > 0 else len(value.data))
    return end + 5 - at if end > 0 and value.last(b"startxref", at, end) >= 0 else 0


def _zip(value: _Value, at: int) -> int:
    data, end = value.data, value.first(b"PK\5\6", at)
    if end < 0 or end + 22 > len(data):
        return 0
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(data) else 0


#: Magic bytes, media types and the validators that confirm them.
SIGNATURES: dict[bytes, tuple[str, Callable[["_Value", int], int]]] = {
    b"RIFF": ("audio/wav", _riff),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\3\4": ("application/zip", _zip),
}
_RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def media_in(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed medium that lies in no earlier one, except inside a container at 0."""
    found: list[tuple[int, int, str]] = []
    value = _Value(data)
    for last, magic in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if found and at < found[-1][0] + found[-1][1] and found[-1][0] > 0:
            continue
        kind, confirm = SIGNATURES[magic]
        if size := confirm(value, at):
            found.append((at, size, _RIFF_TYPES[data[at + 8 : at + 12]] if magic == b"RIFF" else kind))
    return found


def samples_of(data: bytes) -> bytes:
    """The data chunk of a confirmed WAV."""
    place = 12
    while data[place : place + 4] != b"data":
        place += 8 + (n := int.from_bytes(data[place + 4 : place + 8], "little")) + n % 2
    return data[place + 8 : place + 8 + int.from_bytes(data[place + 4 : place + 8], "little")]


def _describe(kind: str, samples: bytes, embedded: int) -> str:
    """Features of the samples, from a histogram that is filled chunk by chunk."""
    n = len(samples)
    if not n:
        return f"{kind};embedded={embedded}"
    counts, crossings, before = np.zeros(256, dtype=np.int64), 0, None
    for start in range(0, n, CHUNK):
        part = np.frombuffer(samples, dtype=np.uint8, count=min(CHUNK, n - start), offset=start)
        counts += np.bincount(part, minlength=256)
        high = part >= 128
        crossings += int(np.count_nonzero(high[1:] != high[:-1])) + int(before is not None and bool(high[0]) != before)
        before = bool(high[-1])
    levels, used = np.arange(256, dtype=np.int64), np.nonzero(counts)[0]
    total, power = int(counts @ levels), int(counts @ levels**2)
    return f"{kind};samples={n};mean={total / n:.6f};rms={(power / n) ** 0.5:.6f};min={used[0]};max={used[-1]};crossings={crossings};embedded={embedded}"


def _sniff(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for declared, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = value.as_py()
            if data is None:
                rows.append((declared, None, None, None, None, None, None, []))
                continue
            found = media_in(data)
            kind = found[0][2] if found and found[0][0] == 0 else UNKNOWN
            embedded = [{"offset": at, "length": size, "type": t} for at, size, t in found if at]
            samples = samples_of(data) if kind == "audio/wav" else b""
            tail = zlib.crc32(samples[-TAIL:]) if samples else None
            digest = hashlib.sha256(samples).hexdigest() if kind == "audio/wav" else None
            rows.append((kind, len(samples), digest, tail, len(data), hashlib.sha256(data).hexdigest(), _describe(kind, samples, len(embedded)), embedded))
        columns = [batch.column(0), *(pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(8)), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def sniff(frame: DataFrame, id_col: str, declared_col: str, media_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the confirmed type, the samples' size and digests, the medium's, features, embedded media, and ``keep``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    embedded = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())]))
    names = [("media_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("embedded", embedded)]
    schema = T.StructType([frame.schema[id_col], *(T.StructField(n, t) for n, t in names), *(frame.schema[k] for k in keep)])
    arrow = to_arrow_schema(schema)
    return frame.select(id_col, declared_col, media_col, *keep).mapInArrow(partial(_sniff, schema=arrow), schema)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, the declared type and the ``media`` bytes.

    Types are declared as uploads declare them, by no look at the bytes: the checksum of
    the text picks one of DECLARED, so most are wrong and sniffing has to correct them.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    declared = F.get(F.array(*map(F.lit, DECLARED)), (F.crc32(data) % len(DECLARED)).cast("int"))
    return docs.select(F.col(id_col), F.octet_length(data).cast("long").alias("n_bytes"), declared.alias("declared"), wave(padded(data)).alias("media"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sniff(store(table(spark, sf_dir, "documents")), "doc_id", "declared", "media", keep=("n_bytes", "declared"))
    corrected = (F.col("media_type") != F.col("declared")).alias("corrected")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "declared", corrected)
