"""Exact n-gram Jaccard join in the metric space of the Jaccard distance ``1 - J``.

1. Equal shingle sets are one class. A class of which more than ``1 - similarity`` of the
   shingles are in no other class can have no partner; it takes no further part. Shingles
   of a quarter of the hash space are looked at for this, against the bound for all of
   them, so nothing that has a partner is lost.
2. **Pivots create Voronoi regions.** Classes that share a least rehash (one of ``KEYS``)
   meet in the smallest of them, a pivot if it is the most common one of any of them.
   Each goes to the nearest pivot that it meets within the radius ``1 - similarity``, to
   which it is so linked; any other is a pivot by itself. All of a region are linked to
   its pivot, so pairs inside need no look.
3. **Windows.** By the triangle inequality only regions whose pivots are within the sum of
   their own radii and the join's radius can have a link between them. Such pivots are
   found by an equi-join over prefixes of rarest shingles, long enough for that sum, with
   length and positional filters, and their distance is computed.
4. **Boundary documents.** For every pair of regions in question, unless other links
   connect them already, those go on whose distance
   to their pivot is at least the pivots' distance less the other region's radius and the
   join's. They are joined in the same way once more, each a region of its own with radius
   0, so that the windows are the links themselves; only documents of components that are
   still different meet.

Links join to classes by star contraction. No step emits the pairs of a group of copies;
regions of thousands have a link for each member. Rarity is a count by ``BUCKETS`` hash
buckets, a table of fixed size; it only orders shingles, and any order is exact.
Shingles are compared by 64-bit hashes, and sets by one.

Documents with fewer words have one shingle, the whole sequence; null and wordless texts
have none and are linked with nothing, not even each other. A component is named by its
smallest id; rows without an id take part under no name. Repeated rows get equal results;
rows of one id with different texts are nodes of their own. Other columns do not matter;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import passing_tables, table, written
from groundplan.llm.simhash import component_names, connected, named_classes

SIZE = 3
#: Hundredths of the union that the intersection of linked sets has at least.
SIMILAR = 90
KEYS = 3
BUCKETS = 1 << 20
#: Ids that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20
REMEMBERED = 300_000
#: What doubles may be off by in a window.
SLACK = 1e-9
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_QUARTER = np.uint64(1 << 62)


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word, 12)
        return code


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    codes = (codes ^ (codes >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return codes ^ (codes >> np.uint64(32))


def shingle_set(text: bytes, size: int, words: _Words) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(size, len(codes))
    hashes = np.full(len(codes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - width + 1 + k])
    return np.unique(hashes)


def set_code(hashes: np.ndarray) -> int:
    code = xxhash.xxh64_intdigest(hashes.tobytes(), 12)
    return code - (1 << 64) if code >> 63 else code


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *rows]).view(np.int64)))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(t, size, words) for t in _texts(part.column(1))]
            codes = pa.array([set_code(s) for s in sets], pa.int64())
            samples = _lists([s[: np.searchsorted(s, _QUARTER)] for s in sets])
            yield pa.RecordBatch.from_arrays([part.column(0), codes, pa.array([len(s) for s in sets], pa.int64()), samples], names=["id", "code", "n", "sample"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sets with a least rehash for every key."""
    words = _Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = [s for t in _texts(batch.column(0).slice(at, 512)) if len(s := shingle_set(t, size, words))]
            keys = [np.array([_mixed(s ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min() for k in range(KEYS)], dtype=np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([set_code(s) for s in sets], pa.int64()), _lists(sets), _lists(keys)], names=["code", "hashes", "keys"])


def partnered(rows: DataFrame, similar: int) -> DataFrame:
    """``code`` of the sets (code, n, sample) of which enough shingles are in another set as well."""
    single = rows.select("code", F.explode("sample").alias("h")).groupBy("h").agg(F.min("code").alias("code"), F.max("code").alias("other")).where("code = other")
    lone = single.groupBy("code").agg(F.count("*").alias("lone"))
    sizes = rows.where("n > 0").groupBy("code").agg(F.first("n").alias("n"))
    return sizes.join(lone, "code", "left").where(100 * F.coalesce(F.col("lone"), F.lit(0)) <= (100 - similar) * F.col("n")).select("code")


def _prefixes(batches: Iterator[pa.RecordBatch], sketch: object) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, rho, reach, hashes, root): the places of each set's rarest shingles, as many as a set within ``reach`` must share one of."""
    counts = np.frombuffer(sketch.value, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            owners, chosen = [], []
            for k, (reach, hashes) in enumerate(zip(part.column(3).to_pylist(), part.column(4), strict=True)):
                own = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
                order = np.lexsort((own, counts[(own % np.uint64(len(counts))).astype(np.int64)]))
                length = len(own) - max(1, int(np.ceil((1 - reach - SLACK) * len(own)))) + 1
                owners.append(np.full(length, k, dtype=np.int32))
                chosen.append(own[order[:length]])
            who = pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *owners]))
            tokens = pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *chosen]).view(np.int64))
            places = pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *(np.arange(len(c), dtype=np.int32) for c in chosen)]))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(who) for c in (0, 1, 2)), tokens, places, part.column(5).take(who)], names=["node", "n", "rho", "token", "place", "root"])


def _distance(both: Column, n: Column, m: Column) -> Column:
    return 1 - both / (n + m - both)


def _measured(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` of nodes with ``both``, the size of the intersection, the sizes ``na`` and ``nb``, and the distance ``d``."""
    left = sets.select(F.col("node").alias(a), F.col("hashes").alias("_ha"), F.col("n").alias("na"))
    right = sets.select(F.col("node").alias(b), F.col("hashes").alias("_hb"), F.col("n").alias("nb"))
    met = pairs.join(left, a).join(right, b).withColumn("both", F.size(F.array_intersect("_ha", "_hb")).cast("long")).drop("_ha", "_hb")
    return met.withColumn("d", _distance(F.col("both"), F.col("na"), F.col("nb")))


def _linked(similar: int) -> Column:
    return 100 * F.col("both") >= similar * (F.col("na") + F.col("nb") - F.col("both"))


def _regions(sets: DataFrame, similar: int) -> DataFrame:
    """(node, pivot, d): each node's nearest pivot of those that it meets in a key; itself if none is near enough."""
    own = sets.select("node", F.col("node").alias("pivot"), F.lit(0.0).alias("d"))
    met = sets.select("node", "n", F.posexplode("keys").alias("k", "key"))
    least = written(met.groupBy("k", "key").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("k", "key", "size", F.col("p.node").alias("pivot"), F.col("p.n").alias("m")), "pivots")
    alike = 100 * F.least("n", "m") >= similar * F.greatest("n", "m")
    pairs = written(met.join(least, ["k", "key"]).where((F.col("node") != F.col("pivot")) & alike).groupBy("node", "pivot").agg(F.max("size").alias("size")), "met")
    near = written(_measured(pairs, sets, "node", "pivot").where(_linked(similar)).select("node", "pivot", "size", "d"), "near")
    # a pivot that is no one's largest is none, so that a group of copies has few
    chosen = near.groupBy("node").agg(F.max(F.struct("size", (-F.col("pivot")).alias("p"))).alias("m")).select((-F.col("m.p")).alias("pivot")).distinct()
    home = near.join(chosen, "pivot", "left_semi").groupBy("node").agg(F.min(F.struct("d", "pivot")).alias("home")).select("node", "home.pivot", "home.d")
    return written(home.unionByName(own.join(near.select("node"), "node", "left_anti")), "regions")


def _rarity(sets: DataFrame) -> object:
    """Shingles counted by bucket, broadcast."""
    found = sets.select(F.explode("hashes").alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("c")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("c").to_numpy()
    return sets.sparkSession.sparkContext.broadcast(counts.tobytes())


def _near(rows: DataFrame, sets: DataFrame, sketch: object, radius: float, widest: float, similar: int, apart: bool = False) -> DataFrame:
    """(node, other, d, linked) of ``rows`` (node, n, rho, root, hashes) whose distance is at most the sum of their ``rho`` and the radius.

    With ``apart`` those of different roots alone: nodes of the root that is the most
    common one of a token meet none of their own.
    """
    asked = rows.select("node", "n", "rho", (F.col("rho") + widest + radius).alias("reach"), "hashes", "root")
    tokens = written(asked.mapInArrow(partial(_prefixes, sketch=sketch), "node long, n long, rho double, token long, place int, root long"), "prefixes")
    share = 1 - (F.col("rho") + F.col("rho_") + radius) - SLACK
    enough = share / (1 + share) * (F.col("n") + F.col("n_"))
    fits = (F.least("n", "n_") >= share * F.greatest("n", "n_")) & (F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_")) >= enough - SLACK)
    second = lambda df: df.select("token", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "rho", "place", "root")))
    if apart:
        kinds = tokens.groupBy("token", "root").agg(F.count("*").alias("size"))
        major = kinds.groupBy("token").agg(F.max(F.struct("size", "root"))["root"].alias("major"), F.count("*").alias("roots")).where("roots > 1").select("token", "major")
        marked = tokens.join(written(major, "majors"), "token")
        once = (F.col("root") != F.col("root_")) & ((F.col("root_") == F.col("major")) | (F.col("node") < F.col("node_")))
        met = marked.where("root <> major").join(second(tokens), "token").where(once & fits)
    else:
        shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "token", "left_semi")
        met = shared.join(second(shared), "token").where((F.col("node") < F.col("node_")) & fits)
    pairs = written(met.select("node", F.col("node_").alias("other"), (F.col("rho") + F.col("rho_") + radius + SLACK).alias("window")).distinct(), "pairs")
    return written(_measured(pairs, sets, "node", "other").where("d <= window").select("node", "other", "d", _linked(similar).alias("linked")), "windows")


def _roots(sets: DataFrame, similar: int) -> DataFrame:
    """(node, root) of the linked ones of ``sets`` (node, n, hashes, keys)."""
    radius, sketch = 1 - similar / 100, _rarity(sets)
    regions = _regions(sets, similar)
    pivots = written(regions.groupBy("pivot").agg(F.max("d").alias("rho")), "radii")
    widest = pivots.agg(F.max("rho")).first()[0] or 0.0
    centres = pivots.withColumnRenamed("pivot", "node").withColumn("root", F.col("node")).join(sets.select("node", "n", "hashes"), "node")
    near = _near(centres, sets, sketch, radius, widest, similar)
    edges = lambda df, b: df.select(F.col("node").alias("a"), F.col(b).alias("b"))
    links = written(edges(regions.where("node <> pivot"), "pivot").unionByName(edges(near.where("linked"), "other")), "links")
    roots = connected(links, look=True)
    open_pairs = near.where("not linked")
    ends = open_pairs.select(F.explode(F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other")))).alias("e"), "d").select("e.*", "d")
    rooted = ends.join(roots.withColumnRenamed("root", "r1"), "node", "left").join(roots.select(F.col("node").alias("other"), F.col("root").alias("r2")), "other", "left")
    apart = rooted.where(F.coalesce("r1", "node") != F.coalesce("r2", "other"))
    least = apart.join(pivots.select(F.col("pivot").alias("other"), "rho"), "other").groupBy("node").agg(F.min(F.col("d") - F.col("rho") - radius - SLACK).alias("least"))
    boundary = regions.join(least.withColumnRenamed("node", "pivot"), "pivot").where("d >= least").select("node")
    alone = sets.join(boundary, "node", "left_semi").join(roots, "node", "left").select("node", "n", "hashes", F.lit(0.0).alias("rho"), F.coalesce("root", "node").alias("root"))
    alone = written(alone, "boundary")
    if alone.isEmpty():
        return roots
    more = _near(alone, alone, sketch, radius, 0.0, similar, apart=True).where("linked")
    return roots if more.isEmpty() else connected(links.unionByName(edges(more, "other")), look=True)


def components(docs: DataFrame, size: int = SIZE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``."""
    kind = docs.schema[id_col].dataType
    with passing_tables(docs.sparkSession):
        schema = T.StructType([T.StructField("id", kind), T.StructField("code", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sample", T.ArrayType(T.LongType()))])
        rows = written(docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(partial(_prints, size=size), schema), "sampled")
        prints = written(rows.select("id", "code", "n"), "prints", stays=True)
        open_codes = written(partnered(rows, similar), "partnered")
        classes = written(named_classes(prints.where("n > 0"), "code", [F.first("n").alias("n")]), "classes")
        wanted = written(classes.join(open_codes, "code", "left_semi").select("code", "node", "n", "first"), "wanted")
        ids = wanted.where(F.col("first").isNotNull()).select(F.col("first").alias(id_col)).distinct()
        ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
        texts = docs.select(id_col, text_col)
        texts = texts.join(ids, id_col, "left_semi").unionByName(texts.where(F.col(id_col).isNull()))
        found = texts.select(F.col(text_col).cast("binary")).mapInArrow(partial(_sets, size=size), "code long, hashes array<long>, keys array<long>")
        found = found.join(wanted.select("code", "node", "n"), "code").groupBy("node", "n").agg(F.first(F.struct("hashes", "keys")).alias("s"))
        sets = written(found.select("node", "n", "s.hashes", "s.keys"), "sets")
        names = written(component_names(classes, _roots(sets, similar), "code"), "names", stays=True)
    named = prints.where("n > 0").join(names, "code").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(prints.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
           ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
    FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sets
    UNION
    SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = doc_id
"""
