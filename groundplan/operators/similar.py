"""Similarity of sequences by longest matching blocks, for each distinct pair once.

Spark has no such function, so pairs go to Arrow batches. They are made distinct first and
sorted by their second text, whose index the matcher keeps from pair to pair. Quotes are
sought by seeds: three-character pieces of the page that the quote has as well vote for
the windows that hold them, and only windows with enough votes are compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.functions import address
from groundplan.operators.lineage_cut import cut

FUZZY, SHORTEST, SEED = 0.85, 12, 3
#: A table of distinct texts of at most so many rows and characters is broadcast; a larger one is joined by a shuffle.
BROADCAST_TEXTS, BROADCAST_CHARS = 100_000, 20_000_000


def with_texts(df: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined to ``found``, a row for each of its distinct texts ``keys``; a text of very many rows is no task of its own."""
    held = cut(found)
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((F.coalesce(F.length(k), F.lit(0)) for k in keys), F.lit(0))), F.lit(0)).alias("chars")).first()
    return df.join(F.broadcast(held) if size.n <= BROADCAST_TEXTS and size.chars <= BROADCAST_CHARS else held, keys, how)


def _ratios(batches: Iterator[pa.RecordBatch], junk: bool) -> Iterator[pa.RecordBatch]:
    matcher, last = SequenceMatcher(autojunk=junk), None
    for batch in batches:
        found = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != last:
                matcher.set_seq2(b)
                last = b
            matcher.set_seq1(a)
            found.append(matcher.ratio())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "ratio"])


def ratios(pairs: DataFrame, junk: bool = True) -> DataFrame:
    """(a, b, ratio) of the distinct ``pairs`` (a, b); null counts as empty. ``junk``: very frequent characters of long second texts are no anchors."""
    texts = pairs.select(F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")).distinct()
    return texts.sortWithinPartitions("b").mapInArrow(partial(_ratios, junk=junk), "a string, b string, ratio double")


def with_ratio(df: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """``df`` with the similarity of two columns as ``name``."""
    keyed = df.withColumns({"_a": F.coalesce(a, F.lit("")), "_b": F.coalesce(b, F.lit(""))})
    found = ratios(keyed.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("ratio").alias(name))
    return with_texts(keyed, found, ["_a", "_b"]).select(*df.columns, name)


def _segments(c: str) -> Column:
    plain = F.transform(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), ","), lambda p: F.regexp_replace(F.regexp_replace(p, r"[^\p{L}\p{N}_\s]", " "), r"^\s+|\s+$", ""))
    return F.filter(plain, lambda p: p != "")


def with_segment_share(df: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """``df`` with the share of the first address's segments that have one at least FUZZY alike in the second."""
    keyed = df.withColumns({"_s": F.coalesce(a, F.lit("")), "_t": F.coalesce(b, F.lit(""))})
    both = keyed.select("_s", "_t").distinct().select("_s", "_t", _segments("_s").alias("left"), _segments("_t").alias("right"))
    each = both.select("_s", "_t", F.size("left").alias("n"), F.posexplode("left").alias("i", "x"), "right").select("_s", "_t", "n", "i", "x", F.explode_outer("right").alias("y"))
    close = with_ratio(each, F.col("x"), F.col("y"), "ratio").groupBy("_s", "_t", "n", "i").agg(F.max(F.when(F.col("y").isNotNull(), F.col("ratio"))).alias("best"))
    shares = close.groupBy("_s", "_t").agg((F.count_if(F.col("best") >= FUZZY) / F.first("n")).alias(name))
    return with_texts(keyed, shares, ["_s", "_t"], "left").select(*df.columns, F.coalesce(name, F.lit(0.0)).alias(name))


def with_comparison(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """``df`` with ``score`` and ``level`` of two addresses: the better of sequence similarity and token overlap."""
    alike = with_ratio(df, address.normal(a), address.normal(b), "_ratio")
    score = F.round(F.greatest("_ratio", address.token_overlap(address.tokens(a), address.tokens(b))), 3)
    return alike.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 0.8, "HIGH").when(F.col("score") >= 0.5, "MEDIUM").otherwise("LOW")).drop("_ratio")


def quote_places(pairs: DataFrame) -> DataFrame:
    """(q, p, place): where, from 0, the window of page ``p`` starts that is most like quote ``q``, of those FUZZY alike; the first of equal ones.

    Windows are as long as the quote, and start at every fourth part of it. With ``M`` of
    ``S`` characters of both texts matched, of at most ``S - 2 M + 1`` blocks, a window
    has at least ``5 M - 2 S - 2`` seeds inside blocks; that bound excludes no window.
    """
    q, p = F.col("q"), F.col("p")
    size, page = F.length(q), F.length(p)
    rows = pairs.where((size >= SHORTEST) & (page > 0)).select("q", "p").distinct()
    step, width = F.greatest(F.lit(1), F.floor(size / 4)).cast("int"), F.least(size, page)
    seeds = F.transform(F.sequence(F.lit(1), size - SEED + 1), lambda k: F.substr(q, k, F.lit(SEED)))
    hits = F.when(page >= SEED, F.filter(F.sequence(F.lit(0), page - SEED), lambda x: F.array_contains(F.col("seeds"), F.substr(p, x + 1, F.lit(SEED))))).otherwise(F.array().cast("array<int>"))
    least = F.greatest(F.lit(1), F.ceil(((5 * FUZZY / 2) - 2) * (width + size) - 2 - 1e-9))
    starts = F.sequence(F.lit(0), F.greatest(page - size, F.lit(0)), step)
    voted = F.filter(starts, lambda s: F.size(F.filter(F.col("hits"), lambda h: (h >= s) & (h <= s + width - SEED))) >= least)
    windows = rows.withColumn("seeds", F.array_distinct(seeds)).withColumn("hits", hits).select("q", "p", F.explode(voted).alias("place"), width.alias("width"))
    windows = windows.withColumn("w", F.substr(p, F.col("place") + 1, F.col("width")))
    alike = ratios(windows.select(F.col("w").alias("a"), F.col("q").alias("b")), junk=False).where(F.col("ratio") >= FUZZY).select(F.col("a").alias("w"), F.col("b").alias("q"), "ratio")
    return windows.join(alike, ["w", "q"]).groupBy("q", "p").agg(F.max_by("place", F.struct("ratio", -F.col("place"))).alias("place"))
