"""Hard-negative mining with a pivot table over vectors augmented for Euclidean distance.

Among rows, an inner product is no distance. With one more component,
``sqrt(M - |x|^2)`` for a row (``M``: the largest squared norm) and 0 for an anchor, it
becomes one: the squared distance of anchor ``q`` and row ``x`` is ``M + |q|^2 - 2 q.x``.
Every row's distances to ``PIVOTS`` rows far from each other are stored beside it. By the
triangle inequality, the difference and the sum of two distances to a pivot bracket the
distance to each other, and so the score; the narrowest bracket of all pivots counts.

* Rows are dealt into blocks of one label of about ``ROWS`` rows, cells of one nearest
  pivot where these are large enough; a hot label, cell or vector fills more blocks.
  Anchors are dealt into parts of about ``ANCHORS``; a block and a part are a task.
* A block is not sent to an anchor if the bounds of its pivot distances exclude every
  score that counts. Inside, rows whose bracket excludes them are skipped, and the exact
  scores of the survivors are compared. Brackets are widened by more than what doubles
  can be wrong by, so they never exclude a row that belongs to the result.
* First the positives: the best rows of the anchor's label. Then, for all positives at
  once, the rows of other labels between the lowest and the highest score that count.

Each task yields at most ``take`` rows an anchor (and positive), which is exact for the
best ``take`` of all; those are ranked by a window over anchors. Only ``SAMPLE`` rows, of
which the pivots are chosen, and counts reach the driver. Pivots decide on speed alone.

Components are ``floor(256 * x)``; they saturate at 64 bits, and shorter vectors count as
filled up with zeros. Scores are exact whatever their size, but saturate at 64 bits when
returned. Rows with a null label or vector or a component that is null or not finite take
no part. Rows without an id take part as rows, behind all others of equal score, not as
anchors. A repeated row (equal id, label and vector) counts once; rows of one id with
other vectors are rows of their own, but never the positives of an anchor of that id.
An anchor without positives, or a positive without negatives, has no rows; an empty table
gives none. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundplan.llm.common import table, written

SCALE = 256
PIVOTS = 16
SAMPLE = 256
ROWS = 16_384
ANCHORS = 4_096
POSITIVES, NEGATIVES = 5, 10
ANCHOR_STEP = 100
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
_LAST = np.iinfo(np.int64).max
_FOUND = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, id long, score long"


def _matrix(column: pa.ChunkedArray, kind: type = np.int64, width: int = 0) -> np.ndarray:
    """Lists as rows, filled up with zeros to the longest or to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    filled = np.zeros((len(sizes), width), dtype=kind)
    filled[np.arange(width) < sizes[:, None]] = flat
    return filled


def points(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, point) of the rows that take part."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    return vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(x.isNotNull() & ~bad, whole).alias("point")).where("label is not null and point is not null")


class PivotTable:
    """Pivots in the augmented space, and distances to them."""

    def __init__(self, sample: list[list[int]], most: float) -> None:
        """``sample``: points to choose from, each next one the farthest from those chosen; ``most``: the largest squared norm."""
        width = max(map(len, sample), default=0)
        rows = np.array([[*p, *[0] * (width - len(p))] for p in sample], dtype=np.float64).reshape(len(sample), width)
        self.most = most
        self.places = np.column_stack([rows, self._rest(rows)])
        chosen, gap = [0], self._gaps(self.places, 0)
        while len(chosen) < PIVOTS and gap.max(initial=0) > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, self._gaps(self.places, chosen[-1]))
        self.places = self.places[chosen]

    @staticmethod
    def _gaps(places: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(((places - places[k]) ** 2).sum(axis=1))

    def _rest(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (rows**2).sum(axis=1), 0))

    def distances(self, rows: np.ndarray, query: bool) -> np.ndarray:
        """Of rows, or of anchors, to all pivots."""
        width = max(rows.shape[1], self.places.shape[1] - 1)
        mine = np.zeros((len(rows), width + 1))
        mine[:, : rows.shape[1]] = rows
        mine[:, -1] = 0 if query else self._rest(mine[:, :-1])
        found = np.zeros((len(rows), len(self.places)))
        for k, place in enumerate(self.places):
            pivot = np.zeros(width + 1)
            pivot[: len(place) - 1], pivot[-1] = place[:-1], place[-1]
            found[:, k] = np.sqrt(((mine - pivot) ** 2).sum(axis=1))
        return found


def _with_distances(batches: Iterator[pa.RecordBatch], pivots: PivotTable, query: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gaps = pivots.distances(_matrix(batch.column(2)).astype(np.float64), query)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(gaps) + 1, dtype=np.int32) * gaps.shape[1]), pa.array(gaps.ravel()))
        cell = pa.array((gaps.argmin(axis=1) if len(gaps) else np.zeros(0)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists, cell], names=["id", "label", "point", "gaps", "cell"])


def _scores(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where all sums are whole numbers below 2^53, else as Python's numbers."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(point).max(initial=0)) * max(len(point), 1)
    if bound * 100 < 1 << 53:
        return (rows.astype(np.float64) @ point.astype(np.float64)).astype(np.int64)
    return rows.astype(object) @ point.astype(object)


def _best(scores: np.ndarray, ids: np.ndarray, take: int) -> list[int]:
    """Places of the ``take`` highest scores, ties by smaller id."""
    if scores.dtype == object:
        return sorted(range(len(scores)), key=lambda k: (-scores[k], ids[k]))[:take]
    if len(scores) > 4 * take:
        edge = np.partition(scores, len(scores) - take)[len(scores) - take]
        near = np.nonzero(scores >= edge)[0]
        return near[np.lexsort((ids[near], -scores[near]))[:take]].tolist()
    return np.lexsort((ids, -scores))[:take].tolist()


def _clip(score: int) -> int:
    return max(-_LAST - 1, min(_LAST, int(score)))


def _search(key: tuple, rows: pa.Table, anchors: pa.Table, most: float, slack: float) -> pa.Table:
    """A block's rows against a part's anchors; anchors with ``wanted`` positives look for negatives, others for positives."""
    found: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        width = max(_matrix(rows.column("point")).shape[1], _matrix(anchors.column("point")).shape[1])
        place, queries = _matrix(rows.column("point"), width=width), _matrix(anchors.column("point"), width=width)
        no_id = rows.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = rows.column("id").fill_null(_LAST).to_numpy()
        if len(np.unique(ids)) < len(ids):
            _, keep = np.unique(np.column_stack([ids, no_id, place]), axis=0, return_index=True)
            place, ids, no_id = place[keep], ids[keep], no_id[keep]
            gaps = _matrix(rows.column("gaps"), np.float64)[keep]
        else:
            gaps = _matrix(rows.column("gaps"), np.float64)
        far = _matrix(anchors.column("gaps"), np.float64)
        for k, (anchor, anchor_id, wanted) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("anchor", "anchor_id", "wanted")), strict=True)):
            squared = float((queries[k].astype(np.float64) ** 2).sum())
            upper = (most + squared - np.abs(gaps - far[k]).max(axis=1) ** 2) / 2 + slack
            lower = (most + squared - (gaps + far[k]).min(axis=1) ** 2) / 2 - slack
            if wanted is None:
                others = np.nonzero((ids != anchor_id) | no_id)[0]
                if len(others) > POSITIVES:
                    edge = np.partition(lower[others], len(others) - POSITIVES)[len(others) - POSITIVES]
                    others = others[upper[others] >= edge]
                scores = _scores(place[others], queries[k])
                for n in _best(scores, ids[others], POSITIVES):
                    at = others[n]
                    found.append((anchor, anchor_id, 0, None, None, None if no_id[at] else int(ids[at]), _clip(scores[n])))
                continue
            goals = [w["score"] for w in wanted]
            inside = np.nonzero((100.0 * upper >= LOW * min(goals)) & (100.0 * lower <= HIGH * max(goals)))[0]
            scores = _scores(place[inside], queries[k])
            for slot, w in enumerate(wanted):
                good = np.nonzero((100 * scores >= LOW * w["score"]) & (100 * scores <= HIGH * w["score"]))[0]
                for n in _best(scores[good], ids[inside[good]], NEGATIVES):
                    at = inside[good[n]]
                    found.append((anchor, anchor_id, slot, w["id"], w["score"], None if no_id[at] else int(ids[at]), _clip(scores[good[n]])))
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    return pa.table([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``block`` of each: of a label and a cell, or of a label's smaller cells together."""
    sizes = rows.groupBy("label", "cell").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("pool", F.when(F.col("size") >= ROWS // 2, F.col("cell")).otherwise(-1))
    pools = sizes.groupBy("label", "pool").agg(F.ceil(F.sum("size") / ROWS).cast("long").alias("parts"))
    homes = written(sizes.join(pools, ["label", "pool"]).select("label", "cell", "pool", "parts"), "homes")
    part = F.pmod(F.xxhash64("id", "point"), F.col("parts"))
    return rows.join(homes, ["label", "cell"]).select("id", "label", "point", "gaps", F.xxhash64("label", "pool", part).alias("block"))


def _meet(rows: DataFrame, sent: DataFrame, most: float, slack: float) -> DataFrame:
    """What the anchors ``sent`` to (block, part) find in the rows of those blocks."""
    pairs = written(sent.select("block", "part").distinct(), "pairs")
    left = rows.join(pairs, "block").select("block", "part", "id", "point", "gaps")
    right = sent.select("block", "part", "anchor", "anchor_id", "point", "gaps", "wanted")
    search = partial(_search, most=most, slack=slack)
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda key, a, b: search(key, a, b), _FOUND)


def _first(found: DataFrame, keys: list[str], take: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: str | Column = "label", anchor_step: int = ANCHOR_STEP) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    taking = points(vectors, id_col, vec_col, F.col(label) if isinstance(label, str) else label)
    norm = F.aggregate("point", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    most = taking.agg(F.max(norm)).first()[0] or 0.0
    sample = [r.point for r in taking.select("point", F.xxhash64("id", "point").alias("_at")).orderBy("_at").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    slack, pivots = 1 + 1e-6 * most, PivotTable(sample, most)
    schema = "id long, label long, point array<long>, gaps array<double>, cell int"
    rows = written(_blocks(written(taking.mapInArrow(partial(_with_distances, pivots=pivots, query=False), schema), "pivot-table")), "blocks")
    asking = taking.where(F.col("id") % anchor_step == 0).dropDuplicates(["id", "label", "point"])
    asking = asking.mapInArrow(partial(_with_distances, pivots=pivots, query=True), schema)
    anchors = written(asking.select(F.xxhash64("id", "label", "point").alias("anchor"), F.col("id").alias("anchor_id"), "label", "point", "gaps"), "anchors")
    count = len(pivots.places)
    bounds = [F.array(*(f(F.col("gaps")[k]) for k in range(count))).alias(n) for f, n in ((F.min, "near"), (F.max, "far"))]
    blocks = written(rows.groupBy("block", "label").agg(*bounds), "bounds")

    share = lambda n: F.greatest(F.ceil(n / ANCHORS), F.lit(1)).cast("int")
    deal = lambda parts: F.pmod(F.xxhash64("anchor"), parts).cast("int").alias("part")
    labels = written(anchors.groupBy("label").agg(share(F.count("*")).alias("parts")), "label-parts")
    pairs = blocks.join(labels, "label").select("block", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = anchors.join(labels, "label").select("*", deal(F.col("parts"))).join(pairs, ["label", "part"])
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("wanted")
    best = _first(_meet(rows, own.select("*", none), most, slack), ["anchor"], POSITIVES)
    chosen = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    chosen = chosen.select("anchor", F.transform("best", lambda b: F.struct(b["id"].alias("id"), b["score"].alias("score"))).alias("wanted"))
    wanting = written(anchors.join(chosen, "anchor"), "wanting")

    parts = max(1, -(-wanting.count() // ANCHORS))
    pairs = blocks.select(F.col("block"), F.col("label").alias("other"), "near", "far", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    reach = F.transform(F.arrays_zip("gaps", "near", "far"), lambda g: F.greatest(F.lit(0.0), g["near"] - g["gaps"], g["gaps"] - g["far"]))
    least, widest = F.array_max(reach), F.array_min(F.zip_with("gaps", "far", lambda a, b: a + b))
    scores = F.transform("wanted", lambda w: w["score"].cast("double"))
    upper, lower = (most + norm - least * least) / 2 + slack, (most + norm - widest * widest) / 2 - slack
    meets = (F.col("other") != F.col("label")) & (100 * upper >= LOW * F.array_min(scores)) & (100 * lower <= HIGH * F.array_max(scores))
    sent = wanting.select("*", deal(F.lit(parts))).join(pairs, "part").where(meets)
    mined = _first(_meet(rows, sent, most, slack), ["anchor", "slot"], NEGATIVES)
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS p
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_dot_product(a.p, b.p)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label
    AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
