"""Quality classifier: pooled random-indexing word vectors and a two-layer numpy network.

Every token has a sparse ternary index vector that follows from its hash. A token's word
vector is its index vector plus the sum of its neighbours' over the training texts. A
document is the mean of its tokens' vectors, standardised; a network with one hidden
layer scores it, and a temperature fitted on rows kept from the training calibrates the
probability. Tokens are runs of letters (lower-cased), digits or symbols inside
blank-separated chunks, and marks for all-capital words and for unknown ones.

Training uses at most ``MAX_LABELLED`` labelled rows, those with the least hash of their
id, whole; of several texts of one id the one with the least hash. The vocabulary (the
``MAX_TOKENS`` most frequent tokens that two of these rows hold; of a run of symbols the
first four say which it is) and the sums are counted in tasks, so the driver gets only
tables of fixed size. Scoring reads every text whole; tokens out of the vocabulary count
as one unknown one.

Null and empty texts are scored as the mean of no vectors. Labels of null or other than
0 and 1, and ids labelled twice with different labels, are not learned from. If fewer
than two classes are labelled, every score is the one class's share (0.5 if nothing is
labelled). Repeated rows get equal scores; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import held_out, table

MAX_LABELLED = 4000
MAX_TOKENS = 8192
DIM = 64
NONZERO = 6
REACH = 2
HIDDEN = 32
EPOCHS = 400
THRESHOLD = 0.3
SAMPLE_TASKS = 8
MEMO_ENTRIES = 400_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w]|_)+")
CAPITALS, DIGITS, OTHER = "\0capitals", "\0digits", "\0other"


def chunk_tokens(chunk: str) -> list[str]:
    found = []
    for token in _TOKEN.findall(chunk):
        if token[0].isalpha():
            found.append(token.lower())
            if len(token) > 1 and token.isupper():
                found.append(CAPITALS)
        else:
            found.append(DIGITS if token[0].isdigit() else token[:4])
    return found


def index_vectors(tokens: list[str]) -> np.ndarray:
    vectors = np.zeros((len(tokens), DIM), dtype=np.int32)
    for k, token in enumerate(tokens):
        seed = xxhash.xxh64_intdigest(token, 7)
        for nth in range(NONZERO):
            draw = xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), nth)
            vectors[k, draw % DIM] += 1 if draw >> 32 & 1 else -1
    return vectors


class _Encoder:
    """Turns texts into rows of token numbers; the last number is for unknown tokens."""

    def __init__(self, tokens: list[str]):
        self.number = {t: k for k, t in enumerate(tokens)}
        self.unknown = self.number[OTHER]
        self.memo: dict[str, list[int]] = {"": []}

    def __call__(self, text: str | None) -> list[int]:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {"": []}
        found: list[int] = []
        memo = self.memo
        for chunk in (text or "").split():
            code = memo.get(chunk)
            if code is None:
                code = memo[chunk] = [self.number.get(t, self.unknown) for t in chunk_tokens(chunk)]
            found += code
        return found


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            seen.update({t for chunk in (text or "").split() for t in chunk_tokens(chunk)})
    yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _add_rows(sums: np.ndarray, to: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the row of ``sums`` that ``to`` names, which may repeat."""
    if len(to):
        order = np.argsort(to, kind="stable")
        named = to[order]
        starts = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
        sums[named[starts]] += np.add.reduceat(rows[order], starts, axis=0)


def _contexts(batches: Iterator[pa.RecordBatch], tokens: list[str]) -> Iterator[pa.RecordBatch]:
    encode, index = _Encoder(tokens), index_vectors(tokens)
    sums = np.zeros((len(tokens), DIM), dtype=np.int64)
    for batch in batches:
        for text in batch.column(1).to_pylist():
            codes = np.array(encode(text), dtype=np.int64)
            for shift in range(1, REACH + 1):
                _add_rows(sums, codes[shift:], index[codes[:-shift]])
                _add_rows(sums, codes[:-shift], index[codes[shift:]])
    yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.astype("<i8").tobytes()], pa.binary())})


def pooled(codes: list[int], vectors: np.ndarray) -> np.ndarray:
    return np.bincount(codes, minlength=len(vectors)) @ vectors / len(codes) if len(codes) > len(vectors) else vectors[codes].mean(axis=0) if codes else np.zeros(DIM, dtype=np.float32)


def _features(batches: Iterator[pa.RecordBatch], tokens: list[str], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    encode = _Encoder(tokens)
    for batch in batches:
        rows = [pooled(encode(t), vectors).tolist() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.float32()))], names=["id", "label", "fold", "x"])


class Network:
    """Two layers; trained by full-batch Adam on log loss, classes weighted alike."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.spread
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(x @ p[0] + p[1])
            error = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - y) * weight
            back = np.outer(error, p[2]) * (1 - hidden**2)
            slopes = [x.T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature, self.bias = p, 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logits(x)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        loss = lambda t: float((weight * np.logaddexp(0, np.where(y == 1, -z, z) / t)).sum())
        self.temperature = min(np.geomspace(0.25, 8, 41), key=loss)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Model:
    def __init__(self, tokens: list[str], vectors: np.ndarray, network: Network | None, share: float):
        self.tokens, self.vectors, self.network, self.share = tokens, vectors, network, share

    def scores(self, texts: list[str | None], encode: _Encoder) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        x = np.array([pooled(encode(t), self.vectors) for t in texts]).reshape(len(texts), DIM)
        return self.network.scores(x)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other")
    chosen = known.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    fold = (F.crc32(F.col("id").cast("string").cast("binary")) % 5).cast("int").alias("fold")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample has at most max_labelled rows, so it may be broadcast and dealt to a fixed number of tasks
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    sample = found.select("id", "text", "label", fold).repartition(SAMPLE_TASKS).persist()
    try:
        counts = sample.mapInArrow(_frequencies, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
        tokens = [r.token for r in counts.orderBy(F.desc("n"), "token").limit(MAX_TOKENS).collect()]
        tokens = [t for t in tokens if t != OTHER] + [OTHER]
        sums = sum((np.frombuffer(r.sums, "<i8").reshape(-1, DIM) for r in sample.mapInArrow(partial(_contexts, tokens=tokens), "sums binary").collect()), np.zeros((len(tokens), DIM)))
        norm = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
        index = index_vectors(tokens) / NONZERO**0.5
        vectors = (0.5 * sums / norm + index).astype(np.float32)
        rows = sample.mapInArrow(partial(_features, tokens=tokens, vectors=vectors), _feature_schema(sample)).collect()
    finally:
        sample.unpersist()
    rows.sort(key=lambda r: (str(r.id), list(r.x)))
    y = np.array([r.label for r in rows], dtype=float)
    if len(set(y)) < 2:
        return Model(tokens, vectors, None, float(y.mean()) if len(y) else 0.5)
    x, kept = np.array([r.x for r in rows], dtype=float), np.array([r.fold for r in rows]) == 1
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept[:] = False
    network = Network(x[~kept], y[~kept])
    if kept.any():
        network.calibrate(x[kept], y[kept])
    return Model(tokens, vectors, network, float(y.mean()))


def _feature_schema(sample: DataFrame) -> T.StructType:
    return T.StructType([sample.schema["id"], T.StructField("label", sample.schema["label"].dataType), T.StructField("fold", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])


def _score(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    encode = _Encoder(model.tokens)
    for batch in batches:
        scores = np.empty(batch.num_rows)
        for start in range(0, batch.num_rows, 512):
            scores[start : start + 512] = model.scores(batch.column(at).slice(start, 512).to_pylist(), encode)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*map(str, range(batch.num_columns)), "score"])


def score(frame: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``frame`` with the column ``score_col``; all other columns and rows stay."""
    if score_col in frame.columns:
        raise ValueError(f"{score_col} is a column already")
    names = frame.columns
    plain = frame.toDF(*map(str, range(len(names))))
    schema = T.StructType([*plain.schema, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(partial(_score, model=model, at=names.index(text_col)), schema).toDF(*names, score_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col)), model, text_col)
    return scored.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns alone."""
    model = fit(docs, labels, id_col, text_col)
    free = "_score" + "_" * max(map(len, docs.columns), default=0)
    return score(docs, model, text_col, free).where(F.col(free) >= threshold).drop(free)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
