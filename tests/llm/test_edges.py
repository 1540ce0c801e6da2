"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundplan.llm import decontaminate, language_id, license_scan, media, packing, quality, repeats, simhash, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, node long, id string"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
TEXTS = [None, "", " \n", "a", "MIT License", "Ünïcode čhars 漢字", LONG, LONG, "the quick brown fox jumps over the lazy dog " * 20]


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, None, None, None, "x", 1, "y") for k, t in enumerate(TEXTS)]
    rows += [(None, "no id", "fr", None, None, None, None, None, None), (3, "a", "en", None, None, None, "x", 1, "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(9)] + [(None, 1, 0), (2, None, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog the quick brown fox"), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")


def test_simhash(docs, none):
    found = simhash.components(docs).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert by[0].fp == by[1].fp == by[2].fp == 0 and by[2].component_id == 0
    assert by[7].component_id == 6 and by[6].fp == by[7].fp
    assert by[None].component_id is None
    assert simhash.components(none).count() == 0


def test_near_duplicates(docs, none):
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 3, 4, 5, 6, 8] and kept.count(None) == 1
    assert simhash.one_of_each(none).count() == 0 and simhash.one_of_each(docs).columns == docs.columns


def test_simhash_of_large_and_repeated_ids(spark):
    """Ids of 2^62 and more keep their names; rows of one id with different texts do not join their classes."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    big = (1 << 62) + 5
    rows = [(big, text(1)), (big + 1, text(1)), ((1 << 63) - 1, text(2)), (-(1 << 63), text(3)), (7, text(4)), (7, text(5)), (8, text(5)), (None, text(6)), (None, text(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {(r.doc_id, r.fp): r.component_id for r in simhash.components(docs).collect()}
    assert {k[0]: v for k, v in by.items() if k[0] not in (7, None)} == {big: big, big + 1: big, (1 << 63) - 1: (1 << 63) - 1, -(1 << 63): -(1 << 63), 8: 7}
    assert [v for k, v in by.items() if k[0] == 7] == [7, 7] and sorted(map(str, (v for k, v in by.items() if k[0] is None))) == [str((1 << 63) - 1), "None"]
    kept = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], *rows[2:6], *rows[7:]], key=str)
    same = spark.createDataFrame([("b", text(1)), ("a", text(1)), ("c", text(2))], "doc_id string, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(same).collect()) == ["a", "c"]
    assert {r.doc_id: r.component_id for r in simhash.components(same).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_near_duplicates_are_those_of_the_shingle_sets(spark):
    """Pairs right at 0.8 are all found, and none below it, however near; against the similarity of the sets."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(400):
        # n + 4 words in one run; the second text goes on with other words, so n - d of n shingles are shared
        n, d = [(90, 10), (90, 11), (90, 13), (9, 1), (9, 2), (180, 20), (180, 21), (180, 30)][k % 8]
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
        other = [*words[: n + 4 - d], *(f"v{x}" for x in rng.integers(0, 1 << 40, d))]
        a, b = ({tuple(t[i : i + 5]) for i in range(n)} for t in (words, other))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if len(a & b) >= 0.8 * len(a | b) else 2 * k + 1}
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert 0 < sum(k != v for k, v in want.items()) < 200


def test_url_filter(spark, labels):
    urls = [(1, "http://a.example.org/es/1"), (2, "https://EXAMPLE.org/en/12?x"), (3, None), (4, "no scheme"), (5, "ftp://x.com#top"), (6, "http://b.com/de/4"), (6, "http://b.com/de/4"), (7, "http://net/a/b/c/d/e/f/9"), (8, "http://notorg/x"), (None, "http://my.org/")]
    pages = spark.createDataFrame([(*u, "v", 1.0) for u in urls], "page_id long, url string, verdict string, badness double")
    found = url_filter.judge(pages, url_filter.labels_of(labels)).collect()
    assert len(found) == len(urls)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert by[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[3][:3] == by[4][:3] == ("", "", None)
    assert by[5][:3] == ("x.com", "", None) and by[6][2:] == ("com/de/", "block") and by[None][2:] == ("org/", "allow")
    assert by[8][2] is None and all(r.verdict in ("allow", "block") for r in found)
    assert url_filter.judge(pages.limit(0), url_filter.labels_of(labels.limit(0))).count() == 0


def test_url_without_a_number_has_no_label(spark):
    """Not even that of a document -1, as which pages without a number once were joined."""
    pages = spark.createDataFrame([(k, "http://h.net/a/b") for k in range(50)], "page_id long, url string")
    marks = spark.createDataFrame([(-1, 1), (42, 1)], "key long, bad int")
    assert {r.verdict for r in url_filter.judge(pages, marks).collect()} == {"allow"}


def test_url_templates_follow_labels(spark):
    pages = spark.createDataFrame([(k, f"http://h.net/{'bad' if k % 2 else 'good'}/{k}") for k in range(80)], "page_id long, url string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(0, 60)], "key long, bad int")
    found = url_filter.judge(pages, marks).collect()
    assert {r.verdict for r in found if r.page_id % 2} == {"block"} and {r.verdict for r in found if not r.page_id % 2} == {"allow"}
    assert {r.template for r in found} == {"/bad/#", "/good/#"}


def test_url_templates_at_any_depth(spark, tmp_path):
    """Paths of up to twelve segments, with some that end where others go on, against the same tree in SQL."""
    import random

    import duckdb

    rng = random.Random(4)
    trunk = ["a", "b", "c", "d", "e", "f", "g"]
    urls = [f"http://{rng.choice(['x', 'y'])}.net/" + "/".join([*trunk[: rng.randint(0, 7)], *(rng.choice(["u", "v", "w7", "", "0a1b2c3d"]) for _ in range(rng.randint(0, 5))), str(k)]) for k in range(400)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *urls[:20], None, "http://x.net"])], "page_id long, url string")
    marks = spark.createDataFrame([(k, rng.randint(0, 1)) for k in range(0, 400, 2)], "doc_id long, quality int")
    found = url_filter.judge(pages, url_filter.labels_of(marks)).collect()
    duck = duckdb.connect()
    for name, df in (("pages", pages), ("labels", marks)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(duck.sql(url_filter.ORACLE_SQL).fetchall())
    deep = spark.createDataFrame([(k, f"http://h.net/a/b/c/d/e/f/{'bad' if k % 2 else 'good'}/{k}") for k in range(80)], "page_id long, url string")
    verdicts = url_filter.judge(deep, spark.createDataFrame([(k, k % 2) for k in range(60)], "key long, bad int")).collect()
    assert {(r.template, r.verdict) for r in verdicts} == {("/a/b/c/d/e/f/bad/#", "block"), ("/a/b/c/d/e/f/good/#", "allow")}


def test_language_sample_has_whole_rows(spark):
    """Rows within the length are all whole, up to the number; a language with long rows alone is learned from the shortest."""
    rows = [(k, f"{chr(97 + k % 26)} word" * 60, "en") for k in range(40)] + [(50, "mot " * 3000, "fr"), (51, "mot " * 2000, "fr"), (52, "...", "fr"), (53, None, "fr"), (54, "123", "de")]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), "text", "lang")
    assert set(sample) == {"en", "fr"} and sample["fr"] == ("mot " * 2000).strip()
    whole = {language_id.letters_of(t) for _, t, lang in rows if lang == "en"}
    assert len(whole) > language_id.SAMPLE_DOCS and sum(sample["en"].count(w) for w in whole) == language_id.SAMPLE_DOCS


def test_media(docs, none):
    found = media.sniff(media.store(docs), "doc_id", "declared", "media", keep=("n_bytes",)).collect()
    for r in found:
        data = (TEXTS[r.doc_id] if r.doc_id is not None else "no id") or ""
        data = data.encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_type == "audio/wav" and r.media_bytes == len(padded) + 44
    assert media.sniff(media.store(none), "doc_id", "declared", "media").count() == 0


def test_media_signatures(spark):
    import gzip
    import struct

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    packed = gzip.compress(b"hello" * 100)
    assert media.media_in(b"junk" + png + b"BM GIF89a" + packed + b"RIFF") == [(4, len(png), "image/png"), (4 + len(png) + 9, len(packed), "application/gzip")]
    broken = png[:-1] + b"\0"
    assert media.media_in(broken) == [] and media.media_in(packed[:-4]) == []
    frame = spark.createDataFrame([(1, "text/plain", bytearray(png)), (2, "image/png", bytearray(b"none")), (3, "x", None)], "id long, declared string, media binary")
    by = {r.id: r for r in media.sniff(frame, "id", "declared", "media").collect()}
    assert (by[1].media_type, by[2].media_type, by[3].media_type, by[3].media_sha256) == ("image/png", media.UNKNOWN, "x", None)


def test_media_types_are_corrected_and_carved(spark):
    """Wrong declarations of every kind; two files one after the other; many magic strings without a trailer."""
    import io
    import zipfile

    pdf = b"%PDF-1.4 startxref 9 %%EOF more startxref 10 %%EOF"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("a", "text")
    assert media.media_in(pdf + b" gap " + pdf) == [(0, len(pdf), "application/pdf"), (len(pdf) + 5, len(pdf), "application/pdf")]
    assert media.media_in(book.getvalue() + pdf)[0] == (0, len(book.getvalue()), "application/zip")
    value = media._Value(b"PK\3\4%PDF-\xff\xd8\xff" * 5000)
    assert media.media_in(value.data) == [] and value.places(b"PK\5\6") == []
    frame = spark.createDataFrame([(1, "image/png", bytearray(pdf)), (2, "application/pdf", bytearray(book.getvalue())), (3, "application/zip", bytearray(b"junk"))], "id long, declared string, media binary")
    assert {r.id: r.media_type for r in media.sniff(frame, "id", "declared", "media").collect()} == {1: "application/pdf", 2: "application/zip", 3: media.UNKNOWN}


def test_media_features():
    """Against whole-array sums, across the ends of chunks."""
    rng = np.random.default_rng(2)
    for n in (1, 64, media.CHUNK - 1, media.CHUNK, 3 * media.CHUNK + 5):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        wide, high = data.astype(np.int64), data >= 128
        want = f"k;samples={n};mean={wide.sum() / n:.6f};rms={((wide * wide).sum() / n) ** 0.5:.6f};min={data.min()};max={data.max()};crossings={(high[1:] != high[:-1]).sum()};embedded=2"
        assert media._describe("k", data.tobytes(), 2) == want


def test_quality(docs, none, labels):
    found = quality.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert {r.held_out for r in found if r.doc_id is not None} <= {True, False}
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(docs, labels.limit(0)).columns == docs.columns


def test_quality_learns(spark):
    rng = np.random.default_rng(0)
    text = lambda good: " ".join(f"{w}{'' if good else '%%%'}" for w in rng.choice(["tree", "house", "river", "stone", "cloud"], 40))
    rows = [(k, text(k % 3 > 0)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows], "doc_id long, quality int")
    found = [r for r in quality.classify(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in found]) > 0.95


def test_language(docs, none):
    found = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == docs.count()
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (0, 1, 2))
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_phrases_are_greedy_longest_matches():
    sample = ("abracadabra banana", "xyz")
    alphabet, tables = language_id._model((("a", sample[0]), ("b", sample[1])))
    classes = language_id._letter_classes(alphabet)

    def brute(text, model):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) + 1 and text[at : at + size] in model:
                size += 1
            at += max(1, size - 1)
            n += 1
        return n

    for text in ("abra banana", "cadab", "qqq", "zyx ab"):
        symbols, starts, _ = language_id._symbols([text], classes, len(alphabet))
        for (moves, _), model in zip(tables, sample, strict=True):
            assert language_id.phrases(symbols[:-1], starts, moves)[0] == brute(text, model), (text, model)


@pytest.mark.parametrize("size", [3, 61, 400])
def test_phrases_do_not_end_at_blocks(monkeypatch, size):
    """Alphabets of one and of three symbols a letter, blocks of 4 and of 1024: the greedy parse of the whole text."""
    rng = np.random.default_rng(size)
    letters = [chr(0x4E00 + k) if size > 61 else chr(0x561 + k % 38 if k > 25 else 97 + k) for k in range(size)] + [" "]
    word = lambda n: "".join(rng.choice(letters, n))
    sample = tuple((k, language_id.letters_of(word(n))) for k, n in (("a", 60), ("b", 3000)))
    alphabet, tables = language_id._model(sample)
    texts = [None, "", "!?", word(5), word(3000), sample[0][1] * 2, word(40) + "żß" + word(10), sample[1][1][5:900]]
    symbols, starts, _ = language_id._symbols(texts, language_id._letter_classes(alphabet), len(alphabet))
    number = {c: k + 1 for k, c in enumerate(alphabet)} | {" ": 0}
    for (_, text), (moves, _) in zip(sample, tables, strict=True):
        edges = language_id.suffix_automaton(language_id.spelled(np.array([number[c] for c in text]), len(alphabet))[0].tolist())
        want = []
        for one in np.split(symbols, starts[1:]):
            n = at = 0
            while at < len(one):
                state, end = 0, at
                while end < len(one) and one[end] in edges[state]:
                    state, end = edges[state][one[end]], end + 1
                n, at = n + 1, max(end, at + 1)
            want.append(n)
        for block in (4, 1024):
            monkeypatch.setattr(language_id, "BLOCK", block)
            assert language_id.phrases(symbols, starts, moves).tolist() == want


def test_languages_of_rare_letters(spark):
    """Languages that share no frequent letter, of 300 letters each, with long and repeated rows and ids."""
    rng = np.random.default_rng(1)
    word = lambda k, n: "".join(chr(0x4E00 + 300 * k + int(x)) for x in rng.integers(0, 300, n))
    rows = [(k // 2, word(k % 3, 200), f"l{k % 3}") for k in range(60)] + [(5, word(1, 20_000), "l1")] * 3
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kinds = {word_: lang for _, word_, lang in rows}
    joined = found.collect()
    assert len(joined) == 63 and {r.lang_pred for r in joined} == {"l0", "l1", "l2"} and len(kinds) == 61
    one = spark.createDataFrame([(k, word(k % 3, 300), None if k % 3 == 0 else f"l{k % 3}") for k in range(60)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == f"l{r.doc_id % 3}" for r in language_id.identify(one).collect() if r.doc_id % 3)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    pieces = packing.pack(docs, tokenizer()).collect()
    ids = {}
    for k, t in [*enumerate(TEXTS), (None, "no id")]:
        ids[k] = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    assert {p.doc_id for p in pieces} == set(ids)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(part.tobytes()) == p.ids_crc32
    assert sum(p.length for p in pieces) == sum(map(len, ids.values())) + len(ids[3])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(none, tokenizer()).count() == 0


def test_token_bytes_match_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["Don't stop!!! it's", "été, Ça va?", "a<|endoftext|>b", "x\x1cy\x85z", "snake_case 12.5%%% İSTANBUL ΟΔΟΣ", "½²³ ﬁ", "İ( aİ_ İ%- Łİ!#", "ß& ȳ$ É_é!"]
    plain = Tokenizer.from_file(tokenizer())
    for text, data in zip(texts, packing.token_bytes(texts, tokenizer(), None), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_least_squares_finds_exact_counts():
    a = packing.fillings()
    x = np.zeros(a.shape[1])
    x[[3, 50, 200]] = [5, 7, 11]
    found = packing.non_negative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.allclose(a @ found, a @ x, atol=1e-6)


def test_decontamination(docs, none, benchmark):
    found = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(8, 1): 13}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.count() == docs.count() - 1 and kept.columns == docs.columns
    assert decontaminate.contaminated(none, benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_decontamination_tolerates_changed_words(spark):
    item = [f"item{k}" for k in range(30)]
    changed = list(item)
    for k in (5, 14, 23):
        changed[k] = "other"
    half = item[:8]
    rows = [(1, "before " + " ".join(changed) + " after"), (2, " ".join(half)), (3, "tiny item here"), (4, " ".join(reversed(item)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "tiny item")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched, r.first_word, r.end_word) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(1, 7, 27, 1, 31), (3, 8, 2, 0, 2)}


def test_warc(spark, tmp_path):
    html = [None, "", "short", "x" * 100, "x" * 100, "WARC/1.0\r\n\r\n" * 30, "é" * 60, "x" * 100]
    pages = spark.createDataFrame([(k, f"http://a/{k}\r\nEvil: 1" if k else None, h, "response") for k, h in enumerate(html)] + [(None, "u", "gone", "")], "page_id long, url string, html string, record_type string")
    warc.write(pages, str(tmp_path / "w"))
    found = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert found.pop(None).record_type == "response"
    assert sorted(found) == list(range(8)) and not any(r.quarantined for r in found.values())
    for k, h in enumerate(html):
        data = (h or "").encode()
        assert (found[k].payload_bytes, found[k].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert [found[k].record_type for k in range(8)] == ["response"] * 4 + ["revisit"] + ["response"] * 2 + ["revisit"] and found[7].refers_to == 3
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "SMALL_BYTES", 100)
    sizes = [10, 90, 1500, 30_000, 0, 700] * 20
    pages = spark.createDataFrame([(k, "u", chr(97 + k % 26) * n + str(k)) for k, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in found) == list(range(120)) and not any(r.quarantined for r in found)
    by: dict = {}
    for r in found:
        by.setdefault(r.archive, []).append(r.payload_bytes)
    assert all(sum(n) <= 4000 or len(n) == 1 for n in by.values())


def test_warc_members_are_read_without_the_rest():
    """Each member is read in chunks from its place; records larger than a chunk too."""
    import gzip
    import os as system

    bodies = [system.urandom(n) for n in (10, 200_000, 65_536, 1)]
    data = b"".join(gzip.compress(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n") for b in bodies)
    assert [payload for kind, *_, payload in warc.salvage(data) if kind == "record"] == bodies
    assert sum(size for _, _, size, _, _ in warc.salvage(data)) == len(data)


def test_warc_salvage():
    import gzip

    def record(k, body):
        digest = hashlib.sha256(body).hexdigest()
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    for pack in (bytes, gzip.compress):
        parts = [pack(record(k, f"body {k} ".encode() * 20)) for k in range(5)]
        damaged = bytearray(b"".join(parts))
        at = len(parts[0]) + len(parts[1]) // 2
        damaged[at : at + 4] = b"\0\0\0\0"
        found = list(warc.salvage(bytes(damaged) + b"tail"))
        assert [warc._page(h.get("warc-record-id")) for kind, _, _, h, _ in found if kind == "record"] == [0, 2, 3, 4]
        gaps = [(start, size) for kind, start, size, _, _ in found if kind == "gap"]
        assert gaps == [(len(parts[0]), len(parts[1])), (len(damaged), 4)]
        assert sum(size for _, _, size, _, _ in found) == len(damaged) + 4


def test_licenses(spark, none):
    texts = [None, "", "Released under the MIT License.", "MIT. License", "the apache license, the Apache-License", "Licensed under CC BY-NC 4.0.\nother line", "GNU General Public License", "mitt license submit license", "Licensed under the Apache License, Version 2.0.\r\n" + LONG]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, labels string, n_words long")
    by = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [by[k].n_words for k in range(5)] == [0, 0, 5, 2, 6]
    assert [by[k].n_base for k in range(9)] == [0, 0, 1, 1, 2, 0, 1, 0, 1]
    assert (by[2].first_word, by[2].last_word, by[4].first_word, by[4].last_word, by[0].first_word) == (3, 3, 1, 4, None)
    assert by[2].base_labels == "mit" and by[4].labels == "apache" and by[5].labels == "cc-by-nc" and by[6].base_labels == "gpl" and by[8].labels == "apache,apache-2.0"
    assert license_scan.scan(none).count() == 0


def test_license_join_is_exact():
    import itertools

    templates = [("a", frozenset(b"one two three four five".split())), ("b", frozenset(b"three four nine ten".split()))]
    order = {t: k for k, t in enumerate(sorted(frozenset().union(*(t for _, t in templates))))}
    join = license_scan._Join(templates, order, 0.75)
    vocabulary = [*order, b"zzz"]
    for size in range(len(vocabulary) + 1):
        for block in itertools.combinations(vocabulary, size):
            want = {k for k, (_, t) in enumerate(templates) if len(t & set(block)) >= 0.75 * len(t)}
            assert {k for k, _ in join.matches(set(block))} == want


def test_license_positions_reject():
    """A template whose first shared token comes too late in the block is no candidate; the prefix filter alone keeps it."""
    templates = [("a", frozenset(b"a b c d e f g h".split())), ("b", frozenset(b"g h i j k l".split()))]
    order = {t: k for k, t in enumerate(b"i j k l a b c d e f g h".split())}
    join = license_scan._Join(templates, order, 0.75)
    block = set(b"c d e f g h".split())
    assert join.candidates(block) == [0]
    late = set(b"i j k c d e".split())  # six tokens, c is in the prefix of a, but only three of them lie from c on
    assert late & {t for t, kept in join.index.items() if any(k == 0 for k, _ in kept)} and len(late) >= join.need[0]
    assert join.candidates(late) == [1] and list(join.matches(late)) == []


def brute_repeats(texts, window):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                covered[i : i + window] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        out.append((len(d), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, dtype=np.uint8)[~covered])).hexdigest()))
    return out


@pytest.mark.parametrize("classes", [8, 1, 3, 33])
def test_repeats(spark, monkeypatch, classes):
    """Against brute force, with classes of all windows of a run, of some, and of one."""
    monkeypatch.setattr(repeats, "CLASSES", classes)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, second = word(180), word(90)
    texts = [None, "", "ab" * 200, word(300), word(50) + passage + word(70), word(20) + passage[:150] + word(10), passage[20:] + second, second + word(60) + second, "same " * 30, "same " * 30, word(99)]
    texts += [word(30) + passage[k : k + 120] + word(30) for k in range(0, 60, 7)]
    docs = spark.createDataFrame([(k if k != 5 else None, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes long, d1 string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats(docs, 64).collect()}
    want = brute_repeats(texts, 64)
    for k in range(len(texts)):
        assert found[k if k != 5 else None] == want[k], k


def test_repeats_of_a_hot_passage(spark, monkeypatch):
    """Many different texts around one passage: each digit's rows follow the number of texts, not of pairs or windows."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    passage = word(900)
    rows = {}
    for n in (100, 400):
        sizes, write = {}, repeats.written

        def counted(df, label, stays=False, sizes=sizes, write=write):
            made = write(df, label, stays)
            sizes[label] = made.count()
            return made

        monkeypatch.setattr(repeats, "written", counted)
        texts = [word(500) + passage + word(500) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = repeats.repeats(docs).collect()
        monkeypatch.undo()
        assert all(r.n_spans == 1 and 900 <= r.n_removed < 920 for r in found)
        rows[n] = sizes
    assert all(rows[400][k] <= 4.6 * rows[100][k] + 10 for k in rows[100])
    assert rows[400]["windows"] < 400 * 2 * (400 - repeats.GRAM) / 3


def test_repeats_edges(docs, none):
    found = {r.doc_id: r for r in repeats.repeats(docs).collect()}
    assert len(found) == docs.count() - 1 and found[6].n_removed == found[6].n_bytes and found[0].n_bytes == 0
    cut = repeats.cut(docs)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()}[7] == ""
    assert repeats.repeats(none).count() == 0 and repeats.cut(none).count() == 0


def test_pipeline_stages(spark, tmp_path, benchmark, labels):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared, base = text(60), text(200)
    near = base.split()
    near[100] = "changed"
    leak = "the quick brown fox jumps over the lazy dog the quick brown fox"
    texts = [text(120) for _ in range(6)] + [base, base, " ".join(near), text(40) + " " + shared + " " + text(40), text(50) + " " + shared, text(30) + " " + leak, None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["quality_filter"]) == set(range(14))
    assert set(seen["near_dedup"]) == set(range(13)) - {7, 8}
    cut = seen["repeat_dedup"]
    assert shared not in cut[9].text and shared not in cut[10].text and cut[0].text == texts[0] and cut[9].n_chars == len(cut[9].text)
    assert set(seen["decontamination"]) == set(range(13)) - {7, 8, 11}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(13)) - {7, 8, 11}


def test_pipeline_edges(spark, tmp_path, docs, none, benchmark, labels):
    """Every stage on nulls, empty and very long texts, repeated rows, clashing columns, and on an empty table."""
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, frame, str(tmp_path))
            assert found.columns == frame.columns and found.schema.simpleString() == frame.schema.simpleString(), name
            if frame is none:
                assert found.count() == 0
            else:
                ids = [r.doc_id for r in found.collect()]
                assert set(ids) <= {*range(9), None}, name
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_repeated_rows(spark, tmp_path, docs, benchmark, labels):
    """What each stage does with the fixture's repeated, null and empty rows."""
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda frame: sorted((-1 if r.doc_id is None else r.doc_id) for r in frame.collect())
    stages = dict(corpus_pipeline.STAGES)
    everything = ids(docs)
    assert ids(stages["quality_filter"](spark, docs, str(tmp_path))) == everything
    assert ids(stages["near_dedup"](spark, docs, str(tmp_path))) == [-1, 0, 3, 4, 5, 6, 8]
    cut = stages["repeat_dedup"](spark, docs, str(tmp_path))
    by = {r.doc_id: r.text for r in cut.collect()}
    assert ids(cut) == everything and by[0] is None and by[1] == "" and by[6] == by[7] == "" and by[5] == TEXTS[5]
    assert ids(stages["decontamination"](spark, docs, str(tmp_path))) == [k for k in everything if k != 8]
