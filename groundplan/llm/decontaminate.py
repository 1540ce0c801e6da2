"""Benchmark decontamination with spaced seeds, in built-in functions only.

Words are runs of letters and digits of the lower-cased text. A mask looks at some of
the words in a window and ignores the others, so a changed word leaves the seeds of
other masks or places alone. The seeds of every place of the benchmark meet
those of every place of every text in a join by hash. Each hit fixes
an alignment of one item with one text; there the words are compared one by one, and
the best-scoring run (a match gains 1, a changed word costs ``PENALTY``) must hold
``MIN_WORDS`` matches, or all but a tenth of an item shorter than that. Items of fewer
words than the shortest mask are compared through the hash of all their words.

The benchmark's seeds are broadcast only if their counted number is at most
``BROADCAST_SEEDS``, and so are the hits, narrow rows, up to ``BROADCAST_HITS``; beyond
it the same joins shuffle both sides.

Null texts and texts or items without words match nothing. Repeated items and rows are
compared each on its own; results are one row per (id, item) pair. Other columns do not
matter; an empty side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.llm.common import table, written

#: Fixed masks: 1 is compared, 0 is ignored. Each has weight 6.
MASKS = ("11111001", "1101100101", "1001011011")
PENALTY = 2
MIN_WORDS = 13
BROADCAST_SEEDS = 2_000_000
BROADCAST_HITS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seed(codes: Column, at: Column, mask: str, name: int) -> Column:
    return F.xxhash64(F.lit(name), *(F.get(codes, at + k) for k, bit in enumerate(mask) if bit == "1"))


def _seeds(codes: Column, n: Column, at: Column) -> Column:
    """The seeds at place ``at`` of ``n`` words; null where a mask does not fit."""
    return F.array(*(F.when(at + len(m) <= n, _seed(codes, at, m, k)) for k, m in enumerate(MASKS)))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(item, item_size, place, seed) of items with ``item_words``, their word hashes."""
    n = F.size("item_words")
    short = min(map(len, MASKS))
    places = F.sequence(F.lit(0), F.greatest(n - short, F.lit(0)))
    at = items.select("item", "item_words", F.explode(places).alias("place"))
    whole = F.when(n < short, F.xxhash64(F.lit(-1), n, F.xxhash64(F.col("item_words"))))
    seeds = F.array_compact(F.array_append(_seeds(F.col("item_words"), n, F.col("place")), whole))
    return at.select("item", n.alias("item_size"), "place", F.explode(seeds).alias("seed"))


def best_run(same: Column) -> Column:
    """The best-scoring run of an array of booleans: its matches, start and end."""
    start = F.struct(*(F.lit(0).alias(k) for k in ("i", "score", "hits", "from", "best", "best_hits", "best_from", "best_to")))

    def step(s: Column, hit: Column) -> Column:
        gain = F.when(hit, 1).otherwise(-PENALTY)
        fresh = s["score"] <= 0
        score = F.when(fresh, gain).otherwise(s["score"] + gain)
        hits = F.when(fresh, F.lit(0)).otherwise(s["hits"]) + hit.cast("int")
        first = F.when(fresh, s["i"]).otherwise(s["from"])
        better = score > s["best"]
        return F.struct(
            (s["i"] + 1).alias("i"), score.alias("score"), hits.alias("hits"), first.alias("from"),
            F.when(better, score).otherwise(s["best"]).alias("best"), F.when(better, hits).otherwise(s["best_hits"]).alias("best_hits"),
            F.when(better, first).otherwise(s["best_from"]).alias("best_from"), F.when(better, s["i"] + 1).otherwise(s["best_to"]).alias("best_to"),
        )

    return F.aggregate(same, start, step)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per (document, item) with an overlap: ``matched`` words and the word range in the text of the best one."""
    items = benchmark.select(F.col(item_col).alias("item"), F.transform(words(F.col(item_text_col)), lambda w: F.xxhash64(w)).alias("item_words")).where(F.size("item_words") > 0)
    seeds = benchmark_seeds(items)
    shortest = min(map(len, MASKS))
    head = seeds.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("item_size") < shortest, F.col("item_size")))).alias("short")).first()
    if head.n <= BROADCAST_SEEDS:
        seeds, items = F.broadcast(seeds), F.broadcast(items)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    codes = texts.select("id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("doc_words"))
    n = F.size("doc_words")
    at = codes.select("id", "doc_words", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("at"))
    found = _seeds(F.col("doc_words"), n, F.col("at"))
    if head.short:  # at most shortest - 1 lengths
        found = F.concat(found, F.array(*(F.when(F.col("at") + k <= n, F.xxhash64(F.lit(-1), F.lit(k), F.xxhash64(F.slice("doc_words", F.col("at") + 1, k)))) for k in head.short)))
    here = at.select("id", "at", F.explode(found).alias("seed"))
    # only ids and places from here on; the words of a text are read again where it has a hit
    hits = here.join(seeds, "seed").select("id", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    hits = written(hits, "hits")
    if hits.count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    aligned = hits.withColumnRenamed("id", "hit").join(texts, F.col("hit").eqNullSafe(F.col("id"))).withColumnRenamed("item", "item_hit").join(items, F.col("item_hit").eqNullSafe(F.col("item")))
    start = F.greatest(F.col("shift"), F.lit(0))
    part = F.transform(F.slice(words(F.col("text")), start + 1, F.size("item_words") + F.col("shift") - start), lambda w: F.xxhash64(w))
    beside = aligned.select("id", "item", "item_words", "shift", start.alias("start"), part.alias("part"))
    same = F.transform("item_words", lambda w, k: F.coalesce(F.get("part", k + F.col("shift") - F.col("start")) == w, F.lit(False)))
    run = beside.select("id", "item", "shift", F.size("item_words").alias("item_size"), best_run(same).alias("run"))
    need = F.least(F.lit(min_words), F.ceil(F.col("item_size") * 0.9).cast("int"))
    kept = run.where(F.col("run.best_hits") >= need).select("id", "item", "item_size", F.struct(F.col("run.best_hits").alias("matched"), (-(F.col("shift") + F.col("run.best_from"))).alias("first"), (F.col("shift") + F.col("run.best_to")).alias("to")).alias("run"))
    best = kept.groupBy("id", "item").agg(F.max("run").alias("run"), F.max("item_size").alias("item_size"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("run.matched").cast("long").alias("matched"), (-F.col("run.first")).cast("long").alias("first_word"), F.col("run.to").cast("long").alias("end_word"), (F.col("run.matched") / F.col("item_size")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without overlap, with their columns; rows with a null id stay unless they overlap under that id too."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_contaminated")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_contaminated"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
