"""The registered queries against their SQL, or against brute force where SQL cannot express them."""

import os
import re
from itertools import pairwise

import numpy as np
import pytest
import xxhash

from groundplan.llm import decontaminate, queries, simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the supplied tables")


def rows_of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.sql(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_simhash_brute_force(spark):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    codes = {}
    for r in rows_of(spark, "documents"):
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        codes[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {k: k for k in codes}
    for a in codes:
        for b in codes:
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 2:
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash"](spark, DATA).collect()}
    assert found == {k: (f"{codes[k]:016x}", find(parent, k)) for k in codes}


@pytest.mark.parametrize("parts", [64, 1])
def test_links_keep_every_class_with_split_shards(spark, monkeypatch, parts):
    """With shards of 3 rows all trees are dealt over parts, or sharded once more; the classes are those of all pairs."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 3)
    monkeypatch.setattr(simhash, "SHARD_PARTS", parts)
    rng = np.random.default_rng(2)
    codes = [int(x) for x in rng.integers(0, 1 << 63, 8)]
    codes += [c ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in codes * 8]
    codes = sorted(set(codes))
    df = spark.createDataFrame([(k, c - (1 << 64) if c >> 63 else c) for k, c in enumerate(codes)], "node long, fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(df, 2)).collect()}
    parent = dict(enumerate(range(len(codes))))
    for a in parent:
        for b in parent:
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 2:
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    assert {k: roots.get(k, k) for k in parent} == {k: find(parent, k) for k in parent}


def best_matches(item, text):
    """The most matches of a best-scoring run over all alignments."""
    found = 0
    for shift in range(1 - len(item), len(text)):
        score = hits = best = best_hits = 0
        for k, w in enumerate(item):
            same = 0 <= k + shift < len(text) and text[k + shift] == w
            if score <= 0:
                score = hits = 0
            score += 1 if same else -decontaminate.PENALTY
            hits += same
            if score > best:
                best, best_hits = score, hits
        found = max(found, best_hits)
    return found


def test_decontamination_brute_force(spark):
    """Every overlap that holds a seed is found, and nothing that all alignments rule out."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    items = {r.item_id: words(r.text) for r in rows_of(spark, "benchmark")}
    docs = {r.doc_id: words(r.text) for r in rows_of(spark, "documents")}
    found = {(r.doc_id, r.item_id): r.matched for r in queries.QUERIES["op7_decontaminate"](spark, DATA).collect()}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(d, i) for d, w in docs.items() for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert want <= set(found)
    for d, i in found:
        assert best_matches(items[i], docs[d]) >= min(decontaminate.MIN_WORDS, -(-len(items[i]) * 9 // 10))


def test_decontamination_finds_changed_overlaps_at_any_place(spark):
    """Up to two changed words in short overlaps, and every sixth word of a whole item, against all alignments."""
    rng = np.random.default_rng(6)
    items, texts = [], []
    for k in range(80):
        item = [f"i{k}w{x}" for x in range(60)]
        n, changed = [(14, 1), (15, 2), (16, 2), (17, 2)][k % 4]
        at = int(rng.integers(0, 61 - n))
        part = item[at : at + n]
        for x in rng.choice(n, changed, replace=False):
            part[x] = "other"
        items.append(item)
        texts.append(["before", *part, "after"])
    items.append([f"whole{x}" for x in range(40)])
    texts.append([w if x % 6 else "other" for x, w in enumerate(items[-1])])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    want = {(k, k): n for k in range(81) if (n := best_matches(items[k], texts[k])) >= decontaminate.MIN_WORDS}
    assert len(want) > 40 and want[80, 80] == 33
    assert {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(docs, benchmark).collect()} == want


def test_packing_brute_force(spark):
    """Every id of every document lies in one piece, whose checksum is that of the tokenizer's ids; sequences have no gaps."""
    import zlib
    from collections import defaultdict

    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in rows_of(spark, "documents")}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in queries.QUERIES["op6_packing"](spark, DATA).collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        pieces[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert pieces.keys() == ids.keys()
    ends = {k: len(v) for k, v in ids.items()}
    for found, last in [(v, ends[k]) for k, v in pieces.items()] + [(v, None) for v in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == last if last is not None else at <= 2048 and at & (at - 1) == 0


def test_media_brute_force(spark):
    """The registered query's digests and features, computed here from the texts."""
    import hashlib
    import struct
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in rows_of(spark, "documents")}
    found = queries.QUERIES["op3_media"](spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        data = texts[r.doc_id]
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        wav = b"RIFF" + struct.pack("<I", len(payload) + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.media_type) == (len(wav), hashlib.sha256(wav).hexdigest(), "audio/wav")
        samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
        want = f"mean={samples.sum() / len(samples):.6f};rms={((samples**2).sum() / len(samples)) ** 0.5:.6f};min={samples.min()};max={samples.max()}"
        assert want in r.feature and r.corrected == (r.declared != "audio/wav")
    assert len({r.declared for r in found}) == 4


def test_pieces_of_two_masks_differ():
    for a, b in pairwise(decontaminate.MASKS):
        assert a != b and a.count("1") == b.count("1") == 6


def test_held_out_accuracy(spark):
    larger = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op4_quality"](spark, larger).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    # most labels are 1, so accuracy says little: the share of pairs in the right order
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.75
    langs = {r.doc_id: r.lang for r in rows_of(spark, "documents")}
    rows = [r for r in queries.QUERIES["op5_language_id"](spark, DATA).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) >= 0.95


def test_suffix_dedup_brute_force(spark):
    """Every 400-byte string of all texts, counted."""
    import hashlib

    data = {r.doc_id: (r.text or "").encode() for r in rows_of(spark, "documents")}
    codes = {k: [hash(d[i : i + 400]) for i in range(len(d) - 399)] for k, d in data.items()}
    values, counts = np.unique(np.concatenate([np.array(c, dtype=np.int64) for c in codes.values()]), return_counts=True)
    many = set(values[counts > 1].tolist())
    want = {}
    for k, d in data.items():
        covered = np.zeros(len(d), dtype=bool)
        for i, code in enumerate(codes[k]):
            if code in many:
                covered[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int), [0]])) == 1).sum())
        want[k] = (len(d), int(covered.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, dtype=np.uint8)[~covered])).hexdigest())
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op10_suffix_dedup"](spark, DATA).collect()}
    assert found == want


def test_near_duplicates_brute_force(spark):
    """All pairs of the supplied documents by the similarity of their five-word shingle sets; one of each class stays."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in rows_of(spark, "documents"):
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {k: k for k in sets}
    near = 0
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and (len(x & y) >= 0.8 * len(x | y)):
                near += x != y
                i, j = sorted((find(parent, a), find(parent, b)))
                parent[j] = i
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert near and found == {k: find(parent, k) for k in parent}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(found.values())
