"""Hard negatives, the Jaccard join and collocations: against brute force on awkward rows, and the defined edge cases."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from groundplan.llm import collocations, jaccard_join, negatives

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# Hard negatives


def mined_by_hand(rows, step=100):
    found, rows = [], [(i, [int(np.floor(256 * x)) for x in v], k) for i, v, k in dict.fromkeys((i, tuple(v), k) for i, v, k in rows if v is not None and k is not None and all(x is not None and np.isfinite(x) for x in v))]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for i, v, k in rows:
        if i is None or i % step:
            continue
        positives = sorted(((j, score(v, w)) for j, w, m in rows if m == k and j != i), key=order)[:5]
        for j, p in positives:
            good = sorted(((n, score(v, w)) for n, w, m in rows if m != k and 30 * p <= 100 * score(v, w) <= 90 * p), key=order)[:10]
            found += [(i, j, rank + 1, n, p, s) for rank, (n, s) in enumerate(good)]
    return sorted(found, key=str)


def vectors_of(rng, n, clusters):
    centres = rng.normal(size=(clusters, 12))
    rows = []
    for k in range(n):
        v = centres[rng.integers(clusters)] + 0.4 * rng.normal(size=12) if k % 3 else centres[0]  # a third are one vector
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("bounds", [(16_384, 4_096), (40, 3)])
def test_hard_negatives_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(negatives, "ROWS", bounds[0])
    monkeypatch.setattr(negatives, "ANCHORS", bounds[1])
    rows = vectors_of(np.random.default_rng(5), 420, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = negatives.hard_negatives(df, anchor_step=20).collect()
    assert sorted((tuple(r) for r in found), key=str) == mined_by_hand(rows, 20)


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [1.0 - k / 50, k / 50, 0.1], k % 2) for k in range(30)]
    odd = [(31, None, 0), (32, [1.0, None, 0.0], 0), (33, [nan, 1.0, 1.0], 1), (34, [inf, 1.0, 1.0], 1), (35, [1.0, 1.0, 1.0], None), (36, [1.0], 0), (37, [], 1), (None, [0.9, 0.1, 0.1], 1), (200, [3e9, 1.0, 0.0], 0), (100, [0.0, 0.0, 0.0], 1)]
    rows = good + odd + good[:4]
    named = [(*r, "x", 1, 2, 3, 4) for r in rows]
    df = spark.createDataFrame(named, "vec_id long, embedding array<double>, label int, block string, part int, id long, anchor long, gaps int")
    found = negatives.hard_negatives(df)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == mined_by_hand(rows)
    assert negatives.hard_negatives(df.limit(0)).collect() == []
    assert negatives.hard_negatives(df.where("label = 1")).collect() == []


# Jaccard join


def shingles_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[k : k + 3]) for k in range(len(words) - 2)} or ({" ".join(words)} if words else set())


def joined_by_hand(rows):
    sets = [shingles_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            root = find(k)
            names[root] = min(names.get(root, i), i)
    return sorted(((i, len(sets[k]), names.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def chains(rng, count, links):
    """Texts that turn into each other a few words at a time, so that regions touch at their borders."""
    texts = []
    for c in range(count):
        size = rng.randrange(30, 200)
        one, other = [f"a{c}x{k}" for k in range(size)], [f"b{c}x{k}" for k in range(size)]
        at = 0
        for _ in range(links):
            at += rng.choice([1, 2, 3, size // 25, size // 15, size // 8])
            texts.append(" ".join(other[:at] + one[at:]))
            if rng.random() < 0.5:
                texts.append(" ".join([*other[:at], *one[at:], "common", "ending", "here"]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = chains(rng, 8, 24)
    rows = list(enumerate(texts + texts[:20] + ["unlike any other text " + str(k) for k in range(10)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_join.components(df).collect()), key=str) == joined_by_hand(rows)


def test_jaccard_join_goes_to_the_borders(spark, monkeypatch):
    """Regions of touching chains leave pairs to the second join, and it finds links."""
    found = []
    inner = jaccard_join._near

    def near(*args, apart=False):
        out = inner(*args, apart=apart)
        found.append((apart, out.where("linked").count()))
        return out

    monkeypatch.setattr(jaccard_join, "_near", near)
    rows = list(enumerate(chains(random.Random(3), 6, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.components(df).collect()), key=str) == joined_by_hand(rows)
    assert found[0][0] is False and found[1][0] and found[1][1] > 0


def test_jaccard_join_edges(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Straße Ä ä"), (8, "straße Ä ä"), (9, long), (10, long + " more"), (11, long), (None, "one two"), (None, long), (4, "one"), (4, "a b c d"), (12, "a b c d"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], "doc_id long, text string, id long, n long, code string, node long")
    found = jaccard_join.components(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == joined_by_hand(rows)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert sorted((tuple(r) for r in jaccard_join.components(df).collect()), key=str) == joined_by_hand(rows)
    assert jaccard_join.components(df.limit(0)).collect() == []
    words = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), (None, "x y z"), ("c", None)], "doc_id string, text string")
    assert sorted((tuple(r) for r in jaccard_join.components(words).collect()), key=str) == sorted([("b", 1, "a"), ("a", 1, "a"), (None, 1, "a"), ("c", 0, "c")], key=str)


# Collocations


def phrases_by_hand(rows, least=10, report=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    chosen = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *words), a in chosen.items():
        if len(words) == 3:
            for part in ((lang, *words[:2]), (lang, *words[1:])):
                longer[part] = max(longer[part], a)
    found = []
    for (lang, *words), a in chosen.items():
        if len(words) == 2 and 100 * longer[(lang, *words)] >= 50 * a:
            continue
        cuts = [(Fraction(1_000_000 * a * a, f[(lang, *words[:k])] * f[(lang, *words[k:])]).__floor__(), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    out = []
    for lang in n:
        for rank, (_, s, a, phrase, left, right) in enumerate(sorted(x for x in found if x[0] == lang)[:report]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=str)


def prose(rng, n):
    vocabulary = ["the", "of", "new", "york", "city", "red", "New", "Ä", "straße", "don't", "x"] + [f"w{k}" for k in range(25)]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[30, 20] + [4] * (len(vocabulary) - 2), k=rng.randrange(0, 60))
        if rng.random() < 0.4:
            words += ["new", "york", "city", rng.choice("abc"), "new york", "york york york"]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\r", " ! "]) for w in words)))
    return rows


@pytest.mark.parametrize("bounds", [(1_000_000, 250_000), (300, 40)])
def test_collocations_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(collocations, "PART", bounds[0])
    monkeypatch.setattr(collocations, "HOT", bounds[1])
    rows = prose(random.Random(4), 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted((tuple(r) for r in collocations.collocations(df).collect()), key=str) == phrases_by_hand(rows)
    few = collocations.collocations(df, least=3, report=7).collect()
    assert sorted((tuple(r) for r in few), key=str) == phrases_by_hand(rows, 3, 7)


def test_collocations_edges(spark):
    long = "one two " * 20_000
    rows = [(None, None), ("en", None), ("en", ""), ("en", " .. ,\n"), ("fr", long), (None, "a b. " * 12), ("und", "a b!"), ("en", "A B a b a b a b a b a b a b a b a b a b")]
    df = spark.createDataFrame([(k, lang, t, "x", 1, 2, "p") for k, (lang, t) in enumerate(rows)] * 2, "doc_id long, lang string, text string, word string, code long, a long, phrase string")
    found = collocations.collocations(df)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == phrases_by_hand(rows * 2)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_000)], "a long, l long, r long")
    assert df.select(collocations._score("l", "r")).first()[0] == 1_000_000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_000)
