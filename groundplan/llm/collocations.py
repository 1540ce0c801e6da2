"""Phrase collocations by pivot partitioning: fragments go to each n-gram's rarest word.

1. Words are counted per language. Their counts, summed by ``BUCKETS`` hash buckets, are a
   table of fixed size, so it can be broadcast; it bounds every word's count from above.
2. Every place of a text is a pivot for the n-grams around it in which it is the rarest
   word (of equally rare ones the leftmost). Its fragment is rewritten for it: words that
   are rarer, and those too rare for any phrase, become blanks, at which it is cut off.
   Fragments are added up in the task that reads them, and those of many pivots travel
   in one row, to the partition of their pivots.
3. A partition counts the n-grams that its pivots own. Each n-gram has one owner, so its
   count is whole there, and those below ``least`` end there. Pivots of over ``HOT``
   occurrences are salted by fragment; their n-grams' parts are summed once more.
4. Cuts, scores and containment are joins over the frequent phrases. A language's are
   ranked in parts, and the best of the parts once more.

A partition has about ``PART`` words, whatever the input; none holds all of a hot word.
Buckets only decide on owners and blanks, so equal counts or shared buckets do not change
results. Words are carried as 64-bit hashes of language and word.

Null text is empty text, null language is ``und``; repeated rows count as often as they
occur; an empty table gives none. Ties rank by higher count, then by the phrase's bytes.
Very long texts are handled in whole; phrases never cross pieces or documents. Other
columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundplan.llm.common import table, written

LEAST = 10
REPORT = 2000
BUCKETS = 1 << 20
PART = 500_000
HOT = 250_000
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 64
#: Words of a task that are added up together, and different words that it remembers.
TOGETHER, REMEMBERED = 400_000, 200_000
_STOP = b"."
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _STOP * 10)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def tokens(text: bytes) -> list[bytes]:
    """Words, with a stop between pieces; no word is a stop."""
    return text.translate(_CLEAN).replace(_STOP, b" . ").split()


def word_code(lang: str, word: bytes) -> int:
    """Never 0, which is a blank."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, 7) or 1


class _Codes(dict):
    """Codes of a language's words, remembered."""

    def __init__(self, lang: str) -> None:
        super().__init__({_STOP: 0})
        self.lang = lang

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[_STOP] = 0
        code = self[word] = word_code(self.lang, word)
        return code


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flushed() -> pa.RecordBatch:
        rows = [(lang, w, word_code(lang, w), n) for lang, own in counts.items() for w, n in own.items() if w != _STOP]
        counts.clear()
        words = pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())
        codes = pa.array(np.array([r[2] for r in rows], dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), words, codes, pa.array([r[3] for r in rows], pa.int64())], names=["lang", "word", "code", "f"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.setdefault(lang, Counter()).update(tokens(text.as_buffer().to_pybytes()))
            if sum(map(len, counts.values())) > REMEMBERED:
                yield flushed()
    yield flushed()


def _mixed(rows: np.ndarray) -> np.ndarray:
    code = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        code = (code ^ (code >> np.uint64(31)) ^ rows[:, k]) * _ODD[k]
    return code ^ (code >> np.uint64(29))


def fragments(codes: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """(pivot, two words to the left, nearest first, two to the right) of every place that owns an n-gram; 0 is a blank."""
    counts = bounds[(codes % np.uint64(len(bounds))).astype(np.int64)]
    codes = np.where(counts < least, np.uint64(0), codes)
    padded = np.zeros(len(codes) + 4, dtype=np.uint64)
    padded[2:-2] = codes
    level = np.zeros(len(codes) + 4, dtype=counts.dtype)
    level[2:-2] = counts
    here = level[2:-2]

    def near(step: int, rarest: np.ndarray) -> np.ndarray:
        at = slice(2 + step, len(padded) - 2 + step)
        return np.where(level[at] >= rarest, padded[at], np.uint64(0))

    before, after = near(-1, here + 1), near(1, here)
    rows = np.column_stack([codes, before, np.where(before > 0, near(-2, here + 1), np.uint64(0)), after, np.where(after > 0, near(2, here), np.uint64(0))])
    return rows[(codes > 0) & ((before > 0) | (after > 0))]


def _routed(batches: Iterator[pa.RecordBatch], sketch: object, parts: int, least: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, salted, n, fragments, counts): arrays of the fragments of one task for one partition."""
    bounds = np.frombuffer(sketch.value, dtype=np.int64)
    known: dict[str, _Codes] = {}
    waiting: list[np.ndarray] = []

    def flushed() -> pa.RecordBatch:
        rows = fragments(np.concatenate([np.zeros(0, dtype=np.uint64), *waiting]), bounds, least)
        waiting.clear()
        code = _mixed(rows)
        salts = -(-bounds[(rows[:, 0] % np.uint64(len(bounds))).astype(np.int64)] // hot)
        salt = np.where(salts > 1, code % np.maximum(salts, 1).astype(np.uint64), np.uint64(0))
        part = (_mixed(np.column_stack([rows[:, 0], salt])) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((code, rows[:, 0], salts > 1, part))
        rows, part, salted = rows[order], part[order], (salts > 1)[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1) | (part[1:] != part[:-1])
        first = np.nonzero(new)[0]
        counts = np.diff(np.append(first, len(rows))).astype(np.int64)
        rows, part, salted = rows[first], part[first], salted[first]
        cut = np.nonzero((part[1:] != part[:-1]) | (salted[1:] != salted[:-1]))[0] + 1
        edges = [0, *cut.tolist(), len(rows)] if len(rows) else [0]
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        starts = [a for a, _ in spans]
        return pa.RecordBatch.from_arrays([
            pa.array(part[starts], pa.int32()), pa.array(salted[starts], pa.bool_()), pa.array([b - a for a, b in spans], pa.int32()),
            pa.array([np.ascontiguousarray(rows[a:b].T).tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
        ], names=["part", "salted", "n", "fragments", "counts"])

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = known.get(lang) or known.setdefault(lang, _Codes(lang))
            found = tokens(text.as_buffer().to_pybytes())
            waiting.append(np.fromiter(map(codes.__getitem__, found), dtype=np.uint64, count=len(found)))
            waiting.append(np.zeros(1, dtype=np.uint64))
            size += len(found) + 1
            if sum(map(len, known.values())) > REMEMBERED:
                known.clear()
            if size > TOGETHER:
                size = 0
                yield flushed()
    yield flushed()


def owned(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of fragments that contain the pivot, as (three words, the last may be blank), and their counts."""
    p, a1, a2, b1, b2 = (rows[:, k] for k in range(5))
    blank = np.zeros_like(p)
    grams, sums = [], []
    for words, last in (((a1, p, blank), a1), ((p, b1, blank), b1), ((a2, a1, p), a2), ((a1, p, b1), a1 * (b1 > 0)), ((p, b1, b2), b2)):
        keep = last > 0
        grams.append(np.column_stack([w[keep] for w in words]))
        sums.append(counts[keep])
    grams, sums = np.concatenate(grams), np.concatenate(sums)
    code = _mixed(grams)
    order = np.argsort(code, kind="stable")
    differ = (grams[order][1:] != grams[order][:-1]).any(axis=1)
    if (differ & (code[order][1:] == code[order][:-1])).any():  # different n-grams of one hash
        order = np.lexsort(grams.T[::-1])
        differ = (grams[order][1:] != grams[order][:-1]).any(axis=1)
    first = np.nonzero(np.concatenate([np.ones(min(1, len(grams)), dtype=bool), differ]))[0]
    return grams[order][first], np.add.reduceat(sums[order], first) if len(first) else sums


def _mined(group: pa.Table, least: int) -> pa.Table:
    """A partition's n-grams: frequent ones, and all parts of those of salted pivots."""
    found, sums = [np.zeros((0, 3), dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for salted in (False, True):
        rows = [r for r in group.to_pylist() if r["salted"] == salted]
        if not rows:
            continue
        data = np.concatenate([np.frombuffer(r["fragments"], dtype=np.uint64).reshape(5, r["n"]).T for r in rows])
        grams, counts = owned(data, np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in rows]))
        keep = counts >= (1 if salted else least)
        found.append(grams[keep])
        sums.append(counts[keep])
    grams = np.concatenate(found).view(np.int64)
    return pa.table([*(pa.array(grams[:, k]) for k in range(3)), pa.array(np.concatenate(sums))], names=["w1", "w2", "w3", "a"])


def frequent(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``words`` (lang, word, code, f), all of them, and ``grams`` (w1, w2, w3, a) of codes: phrases of two and three words that occur ``least`` times; w3 is 0 for two words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words = texts.mapInArrow(_word_counts, "lang string, word string, code long, f long").groupBy("lang", "word", "code").agg(F.sum("f").alias("f"))
    words = written(words, "words")
    total = words.agg(F.sum("f")).first()[0] or 0
    bounds = np.zeros(BUCKETS, dtype=np.int64)
    buckets = words.groupBy(F.pmod("code", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.sum("f").alias("f")).toArrow()
    bounds[buckets.column("bucket").to_numpy()] = buckets.column("f").to_numpy()
    sketch = spark.sparkContext.broadcast(bounds.tobytes())
    parts = max(1, -(-total // PART))
    routed = texts.mapInArrow(partial(_routed, sketch=sketch, parts=parts, least=least, hot=HOT), "part int, salted boolean, n int, fragments binary, counts binary")
    mined = routed.groupBy("part").applyInArrow(lambda group: _mined(group, least), "w1 long, w2 long, w3 long, a long")
    grams = mined.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words, written(grams, "grams")


def _score(left: str, right: str) -> Column:
    """Whole millionths of a * a / (left * right), in decimals of 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(38,0)) * a * a) div (cast({left} as decimal(38,0)) * {right})")


def collocations(docs: DataFrame, least: int = LEAST, report: int = REPORT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: (lang, rank, phrase, a, l, r, n, score)."""
    words, grams = frequent(docs, least, lang_col, text_col)
    common = words.where(F.col("f") >= least)
    singles = {k: common.select(F.col("code").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else [])) for k in (1, 2, 3)}
    two = grams.where("w3 = 0").select("w1", "w2", "a")
    three = grams.where("w3 <> 0")
    within = three.select("a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("part"))
    within = within.groupBy("part.w1", "part.w2").agg(F.max("a").alias("longer"))
    open_two = two.join(within, ["w1", "w2"], "left").where("longer is null or 100 * longer < 50 * a")
    pairs = open_two.join(singles[1], "w1").join(singles[2], "w2").select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"))
    heads = two.select("w1", "w2", F.col("a").alias("f12"))
    tails = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    cut = three.join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"]).join(singles[1], "w1").join(singles[2], "w2").join(singles[3], "w3")
    cut = cut.withColumns({"s1": _score("f1", "f23"), "s2": _score("f12", "f3")})
    early = F.col("s1") <= F.col("s2")
    triples = cut.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= report)
    # a language's best are among the best of each of its parts, so no task ranks all of its phrases
    parts = ranked(pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))), "lang", "part")
    best = ranked(parts, "lang")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), split AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), placed AS (
    SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split)
), one AS (SELECT lang, w1, count(*) AS f FROM placed GROUP BY ALL
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY ALL
), two AS (SELECT lang, w1, w2, count(*) AS f FROM placed WHERE w2 IS NOT NULL GROUP BY ALL
), three AS (SELECT lang, w1, w2, w3, count(*) AS a FROM placed WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
    SELECT lang, w1, w2, max(a) AS a FROM (SELECT lang, w1, w2, a FROM three UNION ALL SELECT lang, w2, w3, a FROM three) GROUP BY ALL
), cuts AS (
    SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
    FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
    LEFT JOIN longer m ON m.lang = t.lang AND m.w1 = t.w1 AND m.w2 = t.w2
    WHERE t.f >= 10 AND (m.a IS NULL OR 100 * m.a < 50 * t.f)
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 1, x.f, y.f
    FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, 2, x.f, y.f
    FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
    SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM scored JOIN total USING (lang)
QUALIFY rank <= 2000
"""
