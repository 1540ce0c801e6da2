"""SimHash near-duplicates: fingerprints, shard BK-trees and connected classes.

A document's fingerprint has a bit set if over half of its shingles' XXH64 hashes have
it. Equal fingerprints are one class from the start, so copies never meet as rows.
Fingerprints within ``radius`` bits are linked. By the pigeonhole principle two of them
agree in all but ``radius`` of ``radius + SPARE`` equal blocks of bits, so each goes to
one shard for every choice of ``SPARE`` blocks. In its shard's BK-tree (children keyed
by their integer Hamming distance to the parent) a search follows only the edges within
the radius of its own distance. A shard yields no pairs but one link from each
fingerprint to the first of its class there, so its output grows with its input alone.
A shard of more than ``SHARD_ROWS`` fingerprints is dealt into up to ``SHARD_PARTS``
parts, and each pair of parts, or part by itself, is a task of its own: the tree of one,
in which the other is searched. So a task has two parts of a shard at most. A shard of
more rows than that many parts hold is first sharded once more, by the bits that its
members need not share yet, in the same way. Shard trees are built in the tasks that
search them and not broadcast: all trees together are as large as the corpus.

The links are joined to classes by alternating large-star and small-star steps, with
minima that aggregate map-side. Nothing about documents reaches the driver but counts.

Words are separated by ASCII white space, A-Z are lower-cased. Null and wordless texts
have fingerprint 0 and are linked like any other. A class is named by its smallest id;
rows without an id take part under no name (null if the class has no id at all).
Repeated rows get equal results; rows of one id with different texts are nodes of their
own. Other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import passing_tables, table, written

SEED = 42
SPARE = 2
SHARD_ROWS = 256
SHARD_PARTS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by blanks; of all words if there are fewer; of nothing if none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros((8, 8), dtype=np.int64)  # by bit of a byte and by byte
    for start in range(0, len(hashes), 255):
        part = hashes[start : start + 255]
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)
            counts[bit] += np.frombuffer(np.array([lanes], dtype="<u8").tobytes(), dtype=np.uint8)
    bits = (counts * 2 > len(hashes)).T.ravel()
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [fingerprint(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else None, size)) for t in batch.column(1)]
        signed = np.array(codes, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType(), False)])
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(partial(_fingerprints, size=size), schema)


class BKTree:
    """Fingerprints by Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, code: int, radius: int) -> list[int]:
        """Numbers of the stored fingerprints within ``radius`` bits."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            node = open_nodes.pop()
            far = (node[0] ^ code).bit_count()
            if far <= radius:
                found.append(node[1])
            for edge, child in node[2].items():
                if far - radius <= edge <= far + radius:
                    open_nodes.append(child)
        return found

    def add(self, code: int, number: int) -> None:
        if self.root is None:
            self.root = [code, number, {}]
            return
        node = self.root
        while True:
            far = (node[0] ^ code).bit_count()
            child = node[2].get(far)
            if child is None:
                node[2][far] = [code, number, {}]
                return
            node = child


def block_masks(radius: int) -> list[int]:
    """The bits of every choice of SPARE out of radius + SPARE blocks."""
    edges = np.linspace(0, 64, radius + SPARE + 1).astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, SPARE)]


def finer_masks(radius: int, mask: int) -> list[int]:
    """The bits of every choice of SPARE out of radius + SPARE blocks of those that ``mask`` leaves out."""
    free = [k for k in range(64) if not mask >> k & 1]
    edges = np.linspace(0, len(free), radius + SPARE + 1).astype(int)
    blocks = [sum(1 << k for k in free[a:b]) for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, SPARE)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def _verified_links(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """As ``_shard_links`` with the rows' shingle hashes: the tree proposes, the Jaccard similarity of the sets decides.

    A row that is only searched joins the classes that it is similar to as well, so
    there is at most one link from a row besides one for each class that it merges.
    """
    shard, tree, roots, nodes, sets, alive, last = None, BKTree(), [], [], [], 0, 0

    def root_of(number: int) -> int:
        while roots[number] != number:
            roots[number] = roots[roots[number]]
            number = roots[number]
        return number

    for batch in batches:
        links: list[tuple[int, int]] = []
        for *key, search, node, code, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != shard:
                shard, tree, roots, nodes, sets, alive, last = key, BKTree(), [], [], [], 0, 0
            unsigned, own = int.from_bytes(code, "little"), np.frombuffer(data, dtype="<u8")
            near = set()
            if nodes and jaccard(own, sets[last]) >= similarity:
                near.add(root_of(last))
            if len(near) < alive:
                for number in tree.near(unsigned, radius):
                    if (root := root_of(number)) not in near and jaccard(own, sets[number]) >= similarity:
                        near.add(root)
                        last = number
            first = min(near, default=None)
            for n in near:
                links.append((node, nodes[n]))
                roots[n] = first
            alive -= max(0, len(near) - 1)
            if search:
                continue
            number = len(nodes)
            nodes.append(node)
            sets.append(own)
            roots.append(number if first is None else first)
            alive += first is None
            tree.add(unsigned, number)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, search, node, code) come sorted, the rows of a part's tree before those only searched in it."""
    shard, tree, roots, nodes = None, BKTree(), [], []
    for batch in batches:
        links: list[tuple[int, int]] = []
        for *key, search, node, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != shard:
                shard, tree, roots, nodes = key, BKTree(), [], []
            unsigned = int.from_bytes(code, "little") if isinstance(code, bytes) else code & 0xFFFFFFFFFFFFFFFF
            near = set()
            for number in tree.near(unsigned, radius):
                while roots[number] != number:
                    roots[number] = roots[roots[number]]
                    number = roots[number]
                near.add(number)
            if search:
                links.extend((node, nodes[n]) for n in near)
                continue
            number = len(nodes)
            nodes.append(node)
            roots.append(number)
            tree.add(unsigned, number)
            if near:
                first = min(near)
                for n in [*near - {first}, number]:
                    roots[n] = first
                    links.append((nodes[n], nodes[first]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _shards_of(code: Column, masks: list[int]) -> Column:
    """A hash of the bits that each of the masks leaves of ``code``."""
    return F.array(*(F.xxhash64(F.lit(k), code.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks)))


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of ``node`` numbers that join all fingerprints ``fp`` of ``classes`` linked within ``radius`` bits."""
    masks = block_masks(radius)
    rows = classes.select("node", "fp", F.posexplode(_shards_of(F.col("fp"), masks)).alias("mask", "shard"))
    sizes = written(rows.groupBy("mask", "shard").agg(F.count("*").alias("size")).where("size > 1"), "shard-sizes")
    sized, most = rows.join(sizes, ["mask", "shard"]), SHARD_ROWS * SHARD_PARTS
    spread = sized.where(F.col("size") <= most).select("shard", "node", "fp", "size")
    if (sizes.agg(F.max("size")).first()[0] or 0) > most:
        finer = F.element_at(F.array(*(_shards_of(F.col("fp"), finer_masks(radius, m)) for m in masks)), F.col("mask") + 1)
        split = sized.where(F.col("size") > most).select("node", "fp", F.explode(F.transform(finer, lambda f: F.xxhash64("mask", "shard", f))).alias("shard"))
        again = written(split.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1"), "finer-sizes")
        spread = spread.unionByName(split.join(again, "shard").select("shard", "node", "fp", "size"))
    spread = _dealt(spread).repartition(F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part", "search", "node")
    return spread.mapInArrow(partial(_shard_links, radius=radius), "a long, b long").where("a <> b").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (shard, node, fp, size) with the pair of parts of the shard that they go to, once for each such pair."""
    parts = F.least(F.ceil(F.col("size") / SHARD_ROWS), F.lit(SHARD_PARTS)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = rows.withColumn("own", own).select("shard", "own", "node", "fp", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    part = (F.least("own", "other") * SHARD_PARTS + F.greatest("own", "other")).alias("part")
    return dealt.select("shard", part, (F.col("own") > F.col("other")).alias("search"), "node", "fp")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge to a smaller one or only edges from larger ones; then contraction is at its end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and `in` > 0)").isEmpty()


def connected(pairs: DataFrame, look: bool = False) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the pairs, by star contraction until nothing changes.

    With ``look`` each round is looked at, which is a job, and saves the round in which nothing changes.
    """
    stars = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are tables, so that both sides of each join are plain exchanges, of which Spark can split a hub's
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        stars = written(small, "stars")
        if look and _are_stars(stars):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


#: Nodes from here on are no ids but hashes of keys; ids that are as large are looked up.
HASHED = 1 << 62
WHOLE = ("byte", "short", "integer", "long")


def named_classes(prints: DataFrame, key: str, aggregates: list[Column]) -> DataFrame:
    """One row per ``key``, a long, with its ``node``, its smallest id ``first`` and the ``aggregates``.

    Whole-number ids name their class's node; so the smallest node of a component is its
    name, and needs no search. Classes without an id, and of those with one smallest id
    (rows of one id with different texts) all but one, get hashed nodes above all those;
    a hashed node and an id of HASHED and more are the same with a chance of one in 2^62.
    Ids of another type have the key for a node.
    """
    grouped = prints.groupBy(key).agg(F.min("id").alias("first"), *aggregates)
    if prints.schema["id"].dataType.typeName() not in WHOLE:
        return grouped.withColumn("node", F.col(key))
    grouped = written(grouped, "grouped")
    hashed = F.shiftrightunsigned(F.xxhash64(key), 2).bitwiseOR(F.lit(HASHED))
    shared = grouped.where(F.col("first").isNotNull()).groupBy("first").agg(F.min(key).alias("_owner"), F.count("*").alias("_n")).where("_n > 1").select("first", "_owner")
    shared = written(shared, "shared-ids")
    if shared.isEmpty():
        return grouped.withColumn("node", F.coalesce(F.col("first").cast("long"), hashed))
    own = F.col("first").isNotNull() & (F.col("_owner").isNull() | (F.col("_owner") == F.col(key)))
    return grouped.join(shared, "first", "left").withColumn("node", F.when(own, F.col("first").cast("long")).otherwise(hashed)).drop("_owner")


def component_names(classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``key`` with ``component_id``, the smallest id of the class's component."""
    named = classes.join(roots, "node", "left").select(key, "first", F.coalesce("root", "node").alias("root"))
    kind = classes.schema["first"].dataType
    if kind.typeName() not in WHOLE:
        names = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "names")
        return named.join(names, "root").select(key, "component_id")
    looked_up = classes.where(F.col("node") >= HASHED).select(F.col("node").alias("root"), F.col("first").alias("component_id"))
    plain = named.where(F.col("root") < HASHED).select(key, F.col("root").cast(kind).alias("component_id"))
    if looked_up.isEmpty():
        return plain
    return plain.unionByName(named.where(F.col("root") >= HASHED).join(looked_up, "root").select(key, "component_id"))


def components(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``fp`` and ``component_id``."""
    prints = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes = written(named_classes(prints, "fp", []), "classes")
    linked = component_names(classes, connected(links(classes, radius)), "fp")
    return prints.join(linked, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# Near duplicates by similarity: wide fingerprints, shards by shared shingles.

WIDE = 4
BANDS, BAND_ROWS = 16, 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _remixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    codes = (hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _ODD[1]
    codes = (codes ^ (codes >> np.uint64(29))) * _ODD[2]
    return codes ^ (codes >> np.uint64(32))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WIDE times 64 bits from as many independent rehashes of distinct shingles."""
    return b"".join(fingerprint(_remixed(hashes, k + 1)).to_bytes(8, "little") for k in range(WIDE))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key per band: the least rehashes of the shingles under BAND_ROWS hash functions."""
    least = [int(_remixed(hashes, 101 + k).min()) if len(hashes) else 0 for k in range(BANDS * BAND_ROWS)]
    keys = [xxhash.xxh64_intdigest(np.array([b, *least[b * BAND_ROWS : (b + 1) * BAND_ROWS]], dtype=np.uint64).tobytes()) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _shingle_set(text: pa.Scalar, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else None, size))


def _set_code(hashes: np.ndarray) -> int:
    """Names a set of shingles, as a signed long."""
    code = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)
    return code - (1 << 64) if code >> 63 else code


def _wide_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, prints, shards = [], [], []
        for text in batch.column(1):
            hashes = _shingle_set(text, size)
            codes.append(_set_code(hashes))
            prints.append(wide_fingerprint(hashes))
            shards.append(band_keys(hashes))
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(codes, pa.int64()), pa.array(prints, pa.binary()), pa.array(shards, pa.list_(pa.int64()))], names=["id", "t1", "t2", "code", "fp", "shards"])


def _set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [_shingle_set(text, size) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([_set_code(h) for h in sets], pa.int64()), pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())], names=["code", "hashes"])


def radius_for(similarity: float) -> int:
    """Bits that candidates of this Jaccard similarity differ in at most: by the angle between them, and six standard deviations.

    Sets of a few shingles differ in more bits than the angle says, as half of their
    hashes is a frequent count; for 4 of 5 the radius is still four deviations off.
    """
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine)) / float(np.pi)
    return round(64 * WIDE * share + 6 * (64 * WIDE * share * (1 - share)) ** 0.5)


def verified_links(docs: DataFrame, classes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``node`` numbers of ``classes`` whose sets have the ``similarity``, enough to join all such that share a band.

    ``docs``: ids and texts, of which only those of classes that share a shard are read for their sets.
    """
    rows = classes.select("node", "fp", F.explode("shards").alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members")).where("size > 1")
    # shards of the same members need one look
    sizes = sizes.groupBy("size", "members").agg(F.min("shard").alias("shard")).select("shard", "size")
    rows = written(rows.join(sizes, "shard"), "shards")
    wanted = written(rows.select("node").distinct().join(classes.select("node", "first", "code"), "node"), "wanted")
    id_col, text_col = docs.columns
    named = docs.join(wanted.where(F.col("first").isNotNull()).select(F.col("first").alias(id_col)), id_col, "left_semi").select(text_col)
    texts = named.union(docs.where(F.col(id_col).isNull()).select(text_col))
    sets = texts.select(F.col(text_col).cast("binary")).mapInArrow(partial(_set_rows, size=size), "code long, hashes binary")
    sets = written(sets.groupBy("code").agg(F.first("hashes").alias("hashes")).join(wanted.select("code", "node"), "code").select("node", "hashes"), "sets")
    spread = _dealt(rows).join(sets, "node").select("shard", "part", "search", "node", "fp", "hashes")
    spread = spread.repartition(F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part", "search", "node")
    return spread.mapInArrow(partial(_verified_links, radius=radius_for(similarity), similarity=similarity), "a long, b long").where("a <> b").distinct()


def _text_keys(text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def _similar(docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, t1, t2, code) of shingle sets, the ``classes`` of equal ones, and the ``roots`` of linked nodes."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("t1", "t2", "code")), T.StructField("fp", T.BinaryType()), T.StructField("shards", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary"), *_text_keys(text_col)).mapInArrow(partial(_wide_rows, size=size), schema)
    prints = written(rows, "fingerprints")
    kept = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "t1", "t2"))).alias("kept")
    classes = written(named_classes(prints, "code", [kept, F.first("fp").alias("fp"), F.first("shards").alias("shards")]), "classes")
    return prints, classes, connected(verified_links(docs.select(id_col, text_col), classes, size, similarity))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``component_id``, for sets of ``size``-word shingles of ``similarity`` or more.

    At this similarity most bits agree but no block of them need do, so the shards are
    bands of least shingle hashes. Fingerprints of WIDE times 64 bits only propose
    pairs there, in a radius far beyond the estimate's spread; a pair is linked if the
    sets of shingle hashes themselves have the similarity.
    """
    prints, classes, roots = _similar(docs, size, similarity, id_col, text_col)
    linked = component_names(classes, roots, "code")
    return prints.select("id", "code").join(linked, "code").select(F.col("id").alias(id_col), "component_id")


def _kept(docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """A written table of the (id, t1, t2) of the documents with an id that stay."""
    _, classes, roots = _similar(docs, size, similarity, id_col, text_col)
    kept = classes.where(F.col("first").isNotNull()).join(roots.where("node <> root"), "node", "left_anti").select("kept.*")
    return written(kept, "kept", stays=True)


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group, that of the smallest id.

    Rows of one id with different texts are different documents; of rows with equal ids
    and texts one stays. Rows without an id stay.
    """
    with passing_tables(docs.sparkSession):
        kept = _kept(docs, size, similarity, id_col, text_col)
    names = docs.columns
    plain = docs.toDF(*map(str, range(len(names))))  # the columns of ``kept`` clash with none of these
    own = F.col(str(names.index(id_col)))
    t1, t2 = _text_keys(str(names.index(text_col)))
    keyed = plain.where(own.isNotNull()).withColumns({"_t1": t1, "_t2": t2})
    named = keyed.join(kept, (own == F.col("id")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left_semi")
    one = named.dropDuplicates([str(names.index(id_col)), "_t1", "_t2"]).drop("_t1", "_t2")
    return one.unionByName(plain.where(own.isNull())).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
