"""Packing token sequences into fixed windows by non-negative least squares.

Every input partition is packed on its own, in groups of a bounded number of
documents, so nothing is shuffled and memory does not depend on the corpus. In a
group, whole windows are cut from long documents first. The rest lengths, rounded
up to ``BINS`` bins, form a histogram; all multisets of at most ``MAX_PARTS`` bins
that fill a window exactly are the columns of a matrix, and non-negative least
squares finds how often to use each of them. The counts are rounded down, the
windows are built, and what remains is packed greedily: it fills the gaps which
the rounding to bins left, then forms windows by itself. What does not fill a
window goes on to the next group, and at a partition's end it is cut at powers of
two, which need no padding.

Null text is empty text, a null id stays null, repeated rows are documents of
their own, and an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import table

WINDOW = 2048
END_ID = 1
BINS = 32
MAX_PARTS = 4
GROUP_DOCS = 4096
GROUP_TOKENS = 4_000_000
MEMO_ENTRIES = 250_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, and what it made of chunks and of the words and symbols in them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    last[[n for token, n in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return tokenizer, {"": b""}, {}, last


#: A Latin word and ASCII symbols behind it, if any, which the vocabulary's pattern always parts.
#: Without U+0130, whose lower case ends in a combining dot that joins the symbols.
_WORD_SYMBOLS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:;=?@\[-`{}~]*)")


def _encode(pieces: list[str], tokenizer, into: dict[str, bytes]) -> None:
    for at in range(0, len(pieces), 20_000):
        part = pieces[at : at + 20_000]
        for piece, code in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            into[piece] = array("I", code.ids).tobytes()


def _encode_words(words: list[str], tokenizer, last: np.ndarray, into: dict[str, bytes]) -> None:
    """As ``_encode``, for pieces whose only word end is their last id: many in one call."""
    for at in range(0, len(words), 1000):
        part = words[at : at + 1000]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.nonzero(last[ids])[0] + 1) * 4
        if len(ends) != len(part) or ends[-1] != 4 * len(ids):
            _encode(part, tokenizer, into)
            continue
        data = ids.tobytes()
        into.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))


def token_bytes(texts: list[str | None], path: str, end_id: int | None = END_ID) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers.

    This vocabulary drops white space and never joins across it, so the ids of a
    text are those of its blank-separated chunks; frequent chunks are remembered. Of
    a chunk that is a word with symbols behind it the two parts are remembered too.
    """
    tokenizer, memo, parts, last = _tokenizer(path)
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
        memo[""] = b""
    if len(parts) > MEMO_ENTRIES:
        parts.clear()
    split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
    new = set().union(*split).difference(memo)
    pairs, single = [], []
    for chunk in new:
        found = _WORD_SYMBOLS.fullmatch(chunk)
        if found:
            word = found[1]
            pairs.append((chunk, word.lower() if word.isascii() else word, found[2]))
        else:
            single.append(chunk)
    _encode(single, tokenizer, memo)
    _encode_words(list({p for _, word, symbols in pairs for p in (word, symbols) if p and p not in parts}), tokenizer, last, parts)
    for chunk, word, symbols in pairs:
        memo[chunk] = parts[word] + parts[symbols] if symbols else parts[word]
    end = b"" if end_id is None else array("I", [end_id]).tobytes()
    return [b"".join(map(memo.__getitem__, chunks)) + end for chunks in split]


@lru_cache(maxsize=4)
def fillings(bins: int = BINS, parts: int = MAX_PARTS) -> np.ndarray:
    """A column for each multiset of at most ``parts`` bin sizes whose sum is ``bins``."""
    found: list[list[int]] = []

    def extend(chosen: list[int], rest: int) -> None:
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            for size in range(min(rest, chosen[-1] if chosen else bins), 0, -1):
                extend([*chosen, size], rest - size)

    extend([], bins)
    matrix = np.zeros((bins + 1, len(found)))
    for k, sizes in enumerate(found):
        for size in sizes:
            matrix[size, k] += 1
    return matrix


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-6:
            break
        free[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (trial[free] > 1e-9).all():
                x = trial
                break
            down = free & (trial <= 1e-9)
            gap = x[down] - trial[down]
            step = float((x[down] / np.where(gap > 0, gap, np.inf)).min()) if (gap > 0).any() else 0.0
            x = x + step * (trial - x)
            free &= x > 1e-9
            x[~free] = 0
            if not free.any():
                break
    return x


class _Packer:
    """Turns documents into (document, start, length, sequence, offset) pieces."""

    def __init__(self, first_sequence: int, window: int):
        self.next_sequence, self.window = first_sequence, window
        self.pool: deque = deque()  # rests that no window holds yet: (document, start, length)
        self.out: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.next_sequence, offset))
            offset += length
        self.next_sequence += 1

    def take(self, most: int) -> tuple:
        """A piece of at most ``most`` tokens from the pool."""
        doc, start, length = self.pool.popleft()
        if length > most:
            self.pool.appendleft((doc, start + most, length - most))
            length = most
        return doc, start, length

    def add_group(self, docs: list) -> None:
        window, unit = self.window, self.window // BINS
        shelves: list[list[tuple]] = [[] for _ in range(BINS + 1)]
        for doc in docs:
            whole = doc[1] // window * window
            for start in range(0, whole, window):
                self.close([(doc, start, window)])
            if rest := doc[1] - whole:
                shelves[-(-rest // unit)].append((doc, whole, rest))
        histogram = np.array([len(x) for x in shelves], dtype=float)
        matrix = fillings()
        counts = np.floor(non_negative_least_squares(matrix, histogram) + 1e-6).astype(int)
        built = []
        for k in np.nonzero(counts)[0]:
            sizes = [s for s in range(BINS, 0, -1) for _ in range(int(matrix[s, k]))]
            for _ in range(counts[k]):
                if any(len(shelves[s]) < sizes.count(s) for s in set(sizes)):
                    break
                built.append([shelves[s].pop() for s in sizes])
        self.pool.extend(x for shelf in reversed(shelves) for x in shelf)
        for pieces in sorted(built, key=lambda p: -sum(x[2] for x in p)):
            gap = window - sum(x[2] for x in pieces)
            while gap and self.pool:
                pieces.append(self.take(gap))
                gap -= pieces[-1][2]
            if gap:
                self.pool.extend(pieces)
            else:
                self.close(pieces)
        self.whole_windows()

    def whole_windows(self) -> None:
        left = sum(x[2] for x in self.pool)
        while left >= self.window:
            self.fill(self.window)
            left -= self.window

    def fill(self, size: int) -> None:
        pieces: list[tuple] = []
        while size:
            pieces.append(self.take(size))
            size -= pieces[-1][2]
        self.close(pieces)

    def finish(self) -> None:
        left = sum(x[2] for x in self.pool)
        while left:
            size = 1 << (left.bit_length() - 1)
            self.fill(size)
            left -= size

    def drain(self) -> list[tuple]:
        done, self.out = self.out, []
        return done


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    packer = _Packer(TaskContext.get().partitionId() << 33, window)

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = [
            [d[0] for d, *_ in pieces],
            [p[1] for p in pieces],
            [p[2] for p in pieces],
            [zlib.crc32(memoryview(d[2])[4 * s : 4 * (s + n)]) for d, s, n, *_ in pieces],
            [d[1] for d, *_ in pieces],
            [p[3] for p in pieces],
            [p[4] for p in pieces],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    group: list[tuple] = []
    tokens = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids), 512):
            coded = token_bytes(texts.slice(at, 512).to_pylist(), path)
            for doc_id, data in zip(ids[at : at + 512], coded, strict=True):
                group.append((doc_id, len(data) // 4, data))
                tokens += len(data) // 4
            if len(group) >= GROUP_DOCS or tokens >= GROUP_TOKENS:
                packer.add_group(group)
                yield rows(packer.drain())
                group, tokens = [], 0
    packer.add_group(group)
    packer.finish()
    yield rows(packer.drain())


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece of a document; see the module's docstring. ``window``: a power of two."""
    kind = docs.schema[id_col].dataType
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.LongType(), False) for n in names)])
    from pyspark.sql.pandas.types import to_arrow_schema

    work = partial(_pack_partition, path=tokenizer_path, window=window, schema=to_arrow_schema(schema))
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), tokenizer_path)
