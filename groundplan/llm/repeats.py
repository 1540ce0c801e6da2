"""Removal of repeated strings by a depth-limited, distributed most-significant-digit radix sort.

Every byte covered by a ``window``-byte string that also starts somewhere else is found.
Suffixes are ordered only through ``window`` bytes, digit by digit, and what is alone in
its group is dropped before the next digit. Digits are hashes of parts of the window,
which find equal groups as bytes in order would, but for all places of a text at once:

* First digit: the ``GRAM``-byte string with the smallest hash inside each window (the
  rightmost of equal ones). Equal windows have it at equal offsets, so they meet in one
  group; neighbouring windows share theirs, so a text has a row only for each run of
  windows with a common one, about ``2 / window`` of its bytes.
* Second digit: the run's whole content. Runs with equal content are repeated as a whole;
  of each content one run goes on, where its gram has several.
* Third digit: the windows of a run fall into ``CLASSES`` by the gram's offset in them.
  The windows of a class have a core in common, which is their digit. Classes of equal
  content are repeated as a whole again, and one of each goes on.
* Last digit: the whole window, for the classes whose core several contents share.

Each digit is an aggregation that combines map-side, so no group is held in one task,
however large: the rows of a digit are in proportion to the runs that the one before
left, never to pairs of them. Equal texts are one text from the start.

Contents are compared by 128-bit hashes inside groups of equal 64-bit gram hashes, so
among ``n`` different strings of a group a wrong match has a chance of ``n * n / 2 ** 129``.

Null text is empty text, shorter texts than ``window`` have nothing to remove, repeated
rows are copies like any other and so are repeated wholly, null ids stay null, an empty
table gives an empty one. A string that overlaps its own copy is repeated too. Other
columns do not matter; ``cut`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.llm.common import passing_tables, release, table, written

WINDOW = 400
GRAM = 32
CLASSES = 8
SEEN = 200_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([c]), 11) for c in range(256)], dtype=np.uint64)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all ``width``-byte strings of ``data``."""
    power, size, level = _BASE, 1, _byte_codes()[data]
    found, done = None, 0
    while True:
        if width & size:
            if found is None:
                found = level
            else:
                found = found[: len(level) - done] * np.uint64(power) + level[done:] if len(level) > done else level[:0]
            done += size
        size *= 2
        if size > width:
            return found[: len(data) - width + 1]
        level = level[: len(level) - size // 2] * np.uint64(power) + level[size // 2 :]
        power = power * power & _MASK


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    codes = (codes ^ (codes >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return codes ^ (codes >> np.uint64(33))


def sliding(values: np.ndarray, width: int, best: np.ufunc, filler: int) -> np.ndarray:
    """``best`` over every ``width`` neighbouring values, from prefixes and suffixes of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, filler, dtype=values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def window_runs(data: bytes, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(gram hash, content hash, first window start, windows, gram's offset in the first) of each run of windows with a common least gram."""
    n = len(data)
    if n < window:
        return
    width = window - GRAM + 1
    grams = _mixed(rolling(np.frombuffer(data, dtype=np.uint8), GRAM))
    least = sliding(grams, width, np.minimum, _MASK)
    around = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    chosen = np.nonzero(sliding(around, width, np.maximum, 0) == grams)[0]
    values, places = grams[chosen].tolist(), chosen.tolist()
    before, after, open_places = [-1] * len(places), [n + window] * len(places), []
    for k, value in enumerate(values):
        while open_places and values[open_places[-1]] >= value:
            after[open_places.pop()] = places[k]
        if open_places:
            before[k] = places[open_places[-1]]
        open_places.append(k)
    for k, place in enumerate(places):
        first, last = max(place - width + 1, before[k] + 1, 0), min(place, after[k] - width, n - window)
        if first <= last:
            yield values[k], xxhash.xxh3_128_intdigest(data[first : last + window], place - first), first, last - first + 1, place - first


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _halves(values: list[int]) -> tuple[pa.Array, pa.Array]:
    return _signed([v >> 64 for v in values]), _signed([v & _MASK for v in values])


def _runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["d1", "d2", "gram", "c1", "c2", "first", "windows", "lead"]
    seen: set[tuple[int, int]] = set()  # copies in one task are scanned once; other tasks' runs of a copy are equal rows
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            owners, rows = [], []
            if len(seen) > SEEN:
                seen.clear()
            for k, (d1, d2, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True)):
                if (d1, d2) in seen:
                    continue
                seen.add((d1, d2))
                own = list(window_runs(text.as_buffer().to_pybytes(), window)) if text.is_valid else []
                rows += own
                owners += [k] * len(own)
            who = pa.array(owners, pa.int32())
            places = [pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), _signed([r[0] for r in rows]), *_halves([r[1] for r in rows]), *places], names=names)


_CLASS = {"class": pa.int32(), "start": pa.int32(), "end": pa.int32(), "core": pa.int64(), "c1": pa.int64(), "c2": pa.int64()}
_PIECE = "d1 long, d2 long, gram long, whole boolean, first int, bytes binary, classes array<struct<class:int,start:int,end:int,core:long,c1:long,c2:long>>"


def _classes_of(windows: int, lead: int, window: int, count: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(class, its first and last window in the run, start and end of the core of all the class's windows), counted from the run's first byte."""
    wide, low = -(-(window - GRAM + 1) // count), window - GRAM - lead
    for number in range(low // wide, (low + windows - 1) // wide + 1):
        start, end = number * wide - low, min(number * wide + wide - 1, window - GRAM) - low
        yield number, max(start, 0), min(end, windows - 1), end, start + window


def _pieces(batches: Iterator[pa.RecordBatch], window: int, count: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that a text is asked for, with the digits of their classes."""
    kinds = {"d1": pa.int64(), "d2": pa.int64(), "gram": pa.int64(), "whole": pa.bool_(), "first": pa.int32(), "bytes": pa.binary()}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows, ends, numbers, starts, lasts, cores, contents = [], [0], [], [], [], [], []
            for d1, d2, text, runs in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                for r in runs:
                    data = text[r["first"] : r["first"] + r["windows"] - 1 + window]
                    rows.append((d1, d2, r["gram"], r["whole"], r["first"], data))
                    for number, one, other, core, stop in _classes_of(r["windows"], r["lead"], window, count):
                        numbers.append(number)
                        starts.append(one)
                        lasts.append(other)
                        cores.append(xxhash.xxh3_64_intdigest(data[core:stop]))
                        contents.append(xxhash.xxh3_128_intdigest(data[one : other + window], number * window + core - one))
                    ends.append(len(numbers))
            parts = [*(pa.array(x, pa.int32()) for x in (numbers, starts, lasts)), _signed(cores), *_halves(contents)]
            classes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=[pa.field(n, t) for n, t in _CLASS.items()]))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())), classes], names=[*kinds, "classes"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (d1, d2, first, bytes, ranges) become a row for each window of the ranges."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            owners, places, codes, asks = [], [], [], []
            for k, (first, data, ranges) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                for r in ranges:
                    numbers = range(r["start"], r["end"] + 1)
                    owners += [k] * len(numbers)
                    places += [first + n for n in numbers]
                    asks += [r["asks"]] * len(numbers)
                    codes += [xxhash.xxh3_128_intdigest(data[n : n + window]) for n in numbers]
            who = pa.array(owners, pa.int32())
            yield pa.RecordBatch.from_arrays([*_halves(codes), part.column(0).take(who), part.column(1).take(who), pa.array(places, pa.int32()), pa.array(asks, pa.bool_())], names=["h1", "h2", "d1", "d2", "place", "asks"])


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def _keys(text_col: str) -> tuple[Column, Column]:
    return F.xxhash64(_bytes(text_col)).alias("d1"), F.xxhash64(F.lit(1), _bytes(text_col)).alias("d2")


def covered(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per distinct text (d1, d2): ``texts`` with its ``rep`` id and ``copies``, and ``spans`` with the array of covered (from, to)."""
    with passing_tables(docs.sparkSession):
        return _covered(docs, window, id_col, text_col)


def _covered(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    keyed = docs.select(F.col(id_col).alias("id"), *_keys(text_col), _bytes(text_col).alias("text"))
    texts = written(keyed.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "texts", stays=True)
    scanned = keyed.where(F.octet_length("text") >= window).select("d1", "d2", "text").mapInArrow(partial(_runs, window=window), "d1 long, d2 long, gram long, c1 long, c2 long, first int, windows int, lead int")
    runs = written(scanned, "runs")
    content = ["gram", "c1", "c2"]
    # equal rows are one place; a content has several if the hashes of its places differ
    place = F.xxhash64("d1", "d2", "first")
    kinds = runs.groupBy(*content).agg(F.min(place).alias("low"), F.max(place).alias("high"), *(F.first(c).alias(c) for c in ("d1", "d2", "first", "windows", "lead")))
    # aggregates that a join needs are tables, so that both its sides are plain exchanges, of which Spark can split a hot key's
    kinds = written(kinds.withColumn("many", F.col("low") != F.col("high")).drop("low", "high"), "kinds")
    release(docs.sparkSession)
    mixed = written(kinds.groupBy("gram").agg(F.count("*").alias("size"), F.min("many").alias("least")).where("size > 1 and not least").select("gram"), "mixed")
    span = lambda first, last: (first.cast("long").alias("from"), (last + window).cast("long").alias("to"))
    whole = runs.join(kinds.where("many").select(*content), content, "left_semi").select("d1", "d2", *span(F.col("first"), F.col("first") + F.col("windows") - 1))
    asked = kinds.join(mixed, "gram", "left_semi").groupBy("d1", "d2").agg(F.collect_list(F.struct("gram", F.col("many").alias("whole"), "first", "windows", "lead")).alias("runs")).join(texts.select("d1", "d2", "rep"), ["d1", "d2"])
    source = keyed.withColumnsRenamed({"d1": "k1", "d2": "k2"})
    met = asked.join(source, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")) & F.col("rep").eqNullSafe(F.col("id")))
    pieces = written(met.select("d1", "d2", "text", "runs").mapInArrow(partial(_pieces, window=window, count=CLASSES), _PIECE), "pieces")

    classes = pieces.select("d1", "d2", "gram", "whole", "first", F.explode("classes").alias("c")).select("d1", "d2", "gram", "whole", "first", "c.*")
    group = ["gram", "class", "core"]
    contents = written(classes.groupBy(*group, "c1", "c2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("d1", "d2", "first", "start", "end", "whole"))), "contents")
    several = written(contents.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1").select(*group), "several")
    alike = classes.where("not whole").join(contents.where("n > 1").select(*group, "c1", "c2"), [*group, "c1", "c2"], "left_semi").select("d1", "d2", *span(F.col("first") + F.col("start"), F.col("first") + F.col("end")))
    asks = (~F.col("whole") & (F.col("n") == 1)).alias("asks")
    ranges = contents.join(several, group, "left_semi").groupBy("d1", "d2", "first").agg(F.collect_list(F.struct("start", "end", asks)).alias("ranges"))
    each = pieces.select("d1", "d2", "first", "bytes").join(ranges, ["d1", "d2", "first"]).mapInArrow(partial(_windows, window=window), "h1 long, h2 long, d1 long, d2 long, place int, asks boolean")
    each = written(each, "windows")
    release(docs.sparkSession)
    shared = written(each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "shared")
    rest = each.where("asks").join(shared, ["h1", "h2"], "left_semi").select("d1", "d2", *span(F.col("place"), F.col("place")))
    spans = whole.unionByName(alike).unionByName(rest).groupBy("d1", "d2").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))
    return texts, written(spans, "spans", stays=True)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for span in spans:
        if found and span["from"] <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], span["to"]))
        else:
            found.append((span["from"], span["to"]))
    return found


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for span in spans for e in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for text, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                joined = merged(spans)
                rows.append((sum(b - a for a, b in joined), len(joined), hashlib.sha256(kept_bytes(text, joined)).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["k1", "k2", "removed", "spans", "sha"])


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` and the digest of what is kept."""
    texts, spans = covered(docs, window, id_col, text_col)
    rows = docs.select(F.col(id_col), *_keys(text_col), F.octet_length(_bytes(text_col)).cast("long").alias("n_bytes"), F.sha2(_bytes(text_col), 256).alias("sha_all"))
    asked = spans.join(texts.where("copies = 1").select("d1", "d2", "rep"), ["d1", "d2"])
    source = docs.select(F.col(id_col).alias("id"), *(k.alias(n) for k, n in zip(_keys(text_col), ("k1", "k2"), strict=True)), _bytes(text_col).alias("text"))
    met = asked.join(source, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")) & F.col("rep").eqNullSafe(F.col("id")))
    cut_rows = met.select("d1", "d2", "text", "spans").mapInArrow(_digests, "k1 long, k2 long, removed long, spans long, sha string")
    copied = texts.where("copies > 1").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.lit(-1).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.sha2(F.lit("").cast("binary"), 256).alias("sha"))
    changed = cut_rows.unionByName(copied)
    joined = rows.join(changed, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    hit = F.col("removed").isNotNull() & (F.col("n_bytes") >= window)
    zero = F.lit(0).cast("long")
    return joined.select(
        id_col, "n_bytes", F.when(hit & (F.col("removed") < 0), F.col("n_bytes")).when(hit, F.col("removed")).otherwise(zero).alias("n_removed"), F.when(hit, F.col("spans")).otherwise(zero).alias("n_spans"), F.when(hit, F.col("sha")).otherwise(F.col("sha_all")).alias("kept_sha256")
    )


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            texts.append(text if text is None or not spans else kept_bytes(text.encode("utf-8"), merged(spans)).decode("utf-8", "ignore"))
        columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1]]
        yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])


def cut(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of its texts; characters of which a part is covered go too. Other columns and all rows stay."""
    texts, spans = covered(docs, window, id_col, text_col)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.lit(1 << 62).cast("long").alias("to")))
    found = texts.join(spans, ["d1", "d2"], "left").where("copies > 1 or spans is not null").select(F.col("d1").alias("_k1"), F.col("d2").alias("_k2"), F.when(F.col("copies") > 1, all_of).otherwise(F.col("spans")).alias("_spans"))
    names = docs.columns
    plain = docs.toDF(*map(str, range(len(names))))
    text = str(names.index(text_col))
    d1, d2 = _keys(text)
    joined = plain.withColumns({"_d1": d1, "_d2": d2}).join(found, (F.col("_d1") == F.col("_k1")) & (F.col("_d2") == F.col("_k2")), "left")
    ready = joined.select(*plain.columns, F.when(F.octet_length(F.col(text)) >= window, F.col("_spans")).alias("_spans"))
    return ready.mapInArrow(partial(_cut, at=names.index(text_col)), plain.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
