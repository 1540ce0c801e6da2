"""License scans by an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
Templates are token sets; a block holds a template if it has at least ``THRESHOLD`` of
the template's tokens. Tokens are ordered by the number of documents that hold them,
rarest first, counted over the whole table. A block can only reach the threshold if it
has one of the template's first ``|T| - need + 1`` tokens (prefix filter), ``need``
template tokens at all (length filter), and if at each of those shared tokens what both
sides have behind it, with what they shared before, can still make up ``need``
(positional filter); the pairs left are verified. Of nested templates in one block only
the widest gives its label. Blocks are lines, and paragraphs of
several lines (runs between blank lines).

Beside that, the places of fixed phrases are found in the word sequence.

A null text is an empty one: no words, no labels (empty strings), score 0. Repeated
rows get equal results, other columns do not matter, an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import table

THRESHOLD = 0.9
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of public licenses and the labels that the join gives.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl-3.0": ["licensed under the GNU General Public License, version 3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace") if not isinstance(text, bytes) else text
    return data.translate(_WORD_BYTES).split()


def template_sets(templates: dict[str, list[str]] | None = None) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words(t))) for label, notices in sorted((templates or TEMPLATES).items()) for t in notices]


def _count(batches: Iterator[pa.RecordBatch], tokens: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if text:
                seen.update(tokens.intersection(words(text)))
    yield pa.RecordBatch.from_pydict({"token": pa.array([t.decode() for t in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def token_order(docs: DataFrame, text_col: str, templates: list[tuple[str, frozenset[bytes]]]) -> dict[bytes, int]:
    """Rank of each template token, rarest first, by the documents that hold it (bounded by the templates)."""
    tokens = frozenset().union(*(t for _, t in templates))
    counts = docs.select(F.col(text_col)).mapInArrow(partial(_count, tokens=tokens), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {row.token.encode(): row.n for row in counts.collect()}
    return {t: k for k, t in enumerate(sorted(tokens, key=lambda t: (found.get(t, 0), t)))}


class _Join:
    """Finds the templates that a block holds."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], order: dict[bytes, int], threshold: float):
        self.order, self.index = order, {}
        self.sets = [tokens for _, tokens in templates]
        self.ordered, self.need = [], []
        for k, (_, tokens) in enumerate(templates):
            self.ordered.append(sorted(tokens, key=order.__getitem__))
            self.need.append(ceil(threshold * len(tokens) - 1e-9))
            for place, token in enumerate(self.ordered[k][: len(tokens) - self.need[k] + 1]):
                self.index.setdefault(token, []).append((k, place))
        self.least = min(self.need)

    def candidates(self, block: set[bytes]) -> list[int]:
        """The templates that the prefix, length and positional filters leave."""
        ordered = sorted(self.order.keys() & block, key=self.order.__getitem__)
        if len(ordered) < self.least:
            return []
        shared: dict[int, int] = {}  # by template: tokens shared so far; -1 once it is out of reach
        for at, token in enumerate(ordered):
            for k, place in self.index.get(token, ()):
                so_far = shared.get(k, 0)
                if so_far >= 0:
                    behind = min(len(ordered) - at, len(self.ordered[k]) - place)
                    shared[k] = so_far + 1 if len(ordered) >= self.need[k] and so_far + behind >= self.need[k] else -1
        return [k for k, n in shared.items() if n > 0]

    def matches(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        for k in self.candidates(block):
            shared = sum(t in block for t in self.ordered[k])
            if shared >= self.need[k]:
                yield k, shared / len(self.ordered[k])


def _blocks(data: bytes) -> Iterator[bytes]:
    for paragraph in data.replace(b"\r\n", b"\n").split(b"\n\n"):
        lines = paragraph.split(b"\n")
        yield from lines
        if len(lines) > 1:
            yield paragraph


def _scan(batches: Iterator[pa.RecordBatch], join: _Join, labels: list[str], phrases: dict[str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    needles = [(b" " + p.encode() + b" ", p.split(" ")[-1].encode(), label) for p, label in phrases.items()]
    keys = join.index.keys()
    for batch in batches:
        rows = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            data = text or b""
            found = words(data)
            places, base, own, score = [], set(), set(), 0.0
            if not keys.isdisjoint(found) or any(last in found for _, last, _ in needles):
                line = b" " + b" ".join(found) + b" "
                for needle, _, label in needles:
                    at, seen, words_before = line.find(needle), 0, 0
                    while at >= 0:
                        words_before += line.count(b" ", seen, at)
                        places.append(words_before)
                        base.add(label)
                        at, seen = line.find(needle, at + 1), at
                for block in _blocks(data):
                    held = list(join.matches(set(words(block))))
                    for k, share in held:
                        if not any(join.sets[k] < join.sets[other] for other, _ in held):
                            own.add(labels[k])
                        score = max(score, share)
            score = 1.0 if base else score
            rows.append((len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score))
        columns = [batch.column(0), *(pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(7))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    sets = template_sets(templates)
    join = _Join(sets, token_order(docs, text_col, sets), threshold)
    names = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in names)])
    work = partial(_scan, join=join, labels=[label for label, _ in sets], phrases=PHRASES, schema=to_arrow_schema(schema))
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Blocks against templates without filters: every block, every template."""
    sets = template_sets()
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    rows = ", ".join(f"({k}, '{label}', {ceil(THRESHOLD * len(t) - 1e-9)}, {len(t)}, [{', '.join(repr(x.decode()) for x in sorted(t))}])" for k, (label, t) in enumerate(sets))
    nested = [(i, j) for i, (_, a) in enumerate(sets) for j, (_, b) in enumerate(sets) if a < b]
    inside = " OR ".join(f"(h.k = {i} AND g.k = {j})" for i, j in nested) or "FALSE"
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) x WHERE " + " AND ".join(f"ws[i + {n}] = '{w}'" for n, w in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    return f"""WITH d AS (SELECT doc_id, replace({low}, chr(13) || chr(10), chr(10)) AS t, {word.format(low)} AS ws FROM documents),
 base AS ({places}),
 b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM base GROUP BY 1),
 par AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS block FROM d),
 blocks AS (SELECT doc_id, row_number() OVER () AS bid, {word.format('block')} AS ws FROM (SELECT doc_id, block FROM par UNION ALL SELECT doc_id, unnest(string_split(block, chr(10))) FROM par) x),
 tpl(k, label, need, size, toks) AS (VALUES {rows}),
 held AS (SELECT doc_id, bid, k, label, len(list_intersect(list_distinct(ws), toks)) * 1.0 / size AS share FROM blocks CROSS JOIN tpl WHERE len(list_intersect(list_distinct(ws), toks)) >= need),
 own AS (SELECT DISTINCT doc_id, label FROM held h WHERE NOT EXISTS (SELECT 1 FROM held g WHERE g.bid = h.bid AND ({inside}))),
 best AS (SELECT doc_id, max(share) AS share FROM held GROUP BY 1),
 bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM base) x GROUP BY 1),
 al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM own) x GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
 coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, CAST(CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN bl ON bl.doc_id = d.doc_id LEFT JOIN al ON al.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id"""


ORACLE_SQL = _oracle()
