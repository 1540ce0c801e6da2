"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A document is parsed greedily against each automaton: a phrase is the longest
string from the present position that occurs in the language's sample. The language
that needs the fewest phrases, normalised by the logarithm of its sample's length,
wins. Texts are reduced to their letters, lower-cased, with one blank for any run of
other characters, and parsed whole. Blocks of ``BLOCK`` symbols of many documents walk
the automata side by side, each from the start state; then the states that the blocks
before them ended in are carried over: both walks of a block are followed until they are
in one state, from where on they are the same, and the phrases are counted anew up to
there. So the parse is that of the text in one piece.

The sample: of each language at most ``SAMPLE_DOCS`` labelled rows of up to ``SAMPLE_CHARS``
characters, those with the least hash, all whole; a language without a row so short is
learned from its shortest row with a letter, whole. Every letter of the sample is
told from every other: the ``SINGLE`` most frequent ones are a symbol each, the others
a sequence of three.

A null text or one without a letter gets ``und`` and score 0, and so does every text
if nothing is labelled. Equal costs go to the first language in sorted order. A letter
that no sample holds is a phrase of its own. Repeated rows get equal results, and of
equal rows one is learned from; other columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundplan.llm.common import held_out, table

SAMPLE_DOCS = 24
SAMPLE_CHARS = 2_000
SINGLE = 61
DIGITS = 32
BLOCK = 1024
BATCH_SYMBOLS = 2_000_000
UNKNOWN = "und"


def letters_of(text: str) -> str:
    """The lower-cased letters, with one blank for any run of other characters between them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def training_sample(docs: DataFrame, train: F.Column, text_col: str, lang_col: str) -> dict[str, str]:
    """Whole labelled texts of each language, reduced to letters; at most SAMPLE_DOCS rows of a language are learned from."""
    code = F.xxhash64(text_col)
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = known.select(F.col(lang_col).alias("lang"), code.alias("code"), F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(0)).alias("over")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("over", "code"))
    chosen = rows.withColumn("rank", rank).where((F.col("rank") == 1) | (F.col("over") == 0) & (F.col("rank") <= SAMPLE_DOCS)).select("lang", "code", "rank")
    texts = known.select(F.col(lang_col).alias("lang"), code.alias("code"), F.col(text_col).alias("text"))
    picked = texts.join(F.broadcast(chosen), ["lang", "code"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    found: dict[str, str] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.rank)):
        letters = letters_of(r.text)
        if letters:
            found[r.lang] = f"{found[r.lang]} {letters}" if r.lang in found else letters
    return found


@lru_cache(maxsize=1)
def _letter_classes(alphabet: str) -> np.ndarray:
    """For each code point: 0 for no letter, 1 and more for the letters of the alphabet, one more than their number for others."""
    classes = np.zeros(0x110000, dtype=np.uint16 if len(alphabet) < 60_000 else np.uint32)
    for start in range(0, 0x110000, 0x800):
        if 0xD800 <= start < 0xE000:
            continue
        classes[start : start + 0x800] = [len(alphabet) + 1 if chr(c).isalpha() else 0 for c in range(start, start + 0x800)]
    for k, c in enumerate(alphabet):
        classes[ord(c)] = k + 1
        if len(c.upper()) == 1 and c.upper() not in alphabet:
            classes[ord(c.upper())] = k + 1
    return classes


def spelled(classes: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Symbols of letter classes, and how many each has if not one; those of rare letters are three of DIGITS, those above ``letters`` SINGLE + 1."""
    plain = np.where(classes > min(letters, SINGLE), SINGLE + 1, classes).astype(np.uint8)
    if letters <= SINGLE:
        return plain, None
    rare = (classes > SINGLE) & (classes <= letters)
    sizes = np.where(rare, 3, 1)
    symbols = np.repeat(plain, sizes)
    at, code = (np.cumsum(sizes) - sizes)[rare], classes[rare].astype(np.int64) - SINGLE - 1
    for k in range(3):
        symbols[at + k] = SINGLE + 2 + code // DIGITS ** (2 - k) % DIGITS
    return symbols, sizes


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in edges[p]:
            edges[p][s] = new
            p = link[p]
        if p >= 0:
            q = edges[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(s) == q:
                    edges[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


@lru_cache(maxsize=1)
def _model(sample: tuple[tuple[str, str], ...]) -> tuple[str, list[tuple[np.ndarray, float]]]:
    """The alphabet, most frequent letters first, and per language a table of next state and closed phrases by state and symbol."""
    counts = Counter(c for _, text in sample for c in text if c != " ")
    alphabet = "".join(sorted(counts, key=lambda c: (-counts[c], c)))
    number = {c: k + 1 for k, c in enumerate(alphabet)} | {" ": 0}
    width = SINGLE + 2 + (DIGITS if len(alphabet) > SINGLE else 0)
    tables = []
    for _, text in sample:
        symbols, _ = spelled(np.array([number[c] for c in text], dtype=np.int64), len(alphabet))
        edges = suffix_automaton(symbols.tolist())
        start = np.full(width, 2, dtype=np.int32)  # an unseen symbol closes the phrase before it and is one
        for s, state in edges[0].items():
            start[s] = state * width * 4 + 1
        moves = np.tile(start, (len(edges), 1))
        moves[0] = np.where(start == 2, 1, start & ~np.int32(3))  # nothing is open at the start state
        for state, out in enumerate(edges):
            for s, to in out.items():
                moves[state, s] = to * width * 4
        tables.append((moves.ravel(), float(np.log2(max(2, len(symbols))))))
    return alphabet, tables


def _walk(symbols: np.ndarray, at: np.ndarray, size: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last state and closed phrases of blocks, each from the start state."""
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    alive = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than each step
    state, count = np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=np.int32)
    for step in range(BLOCK):
        n = alive[step]
        if not n:
            break
        code = moves[state[:n] + symbols[at[:n] + step]]
        count[:n] += code & 3
        state[:n] = code >> 2
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return state[back], count[back]


def _carried(symbols: np.ndarray, at: np.ndarray, size: np.ndarray, entry: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks entered in the states ``entry`` instead of the start state: how many more phrases they close, and their last state (-1: the same)."""
    lane = np.nonzero(entry)[0]
    more, last = np.zeros(len(at), dtype=np.int32), np.full(len(at), -1, dtype=np.int32)
    true, own, step = entry[lane].astype(np.int32), np.zeros(len(lane), dtype=np.int32), 0
    while len(lane):
        done = step >= size[lane]
        if done.any():
            last[lane[done]] = true[done]
            lane, true, own = lane[~done], true[~done], own[~done]
            if not len(lane):
                break
        symbol = symbols[at[lane] + step]
        a, b = moves[true + symbol], moves[own + symbol]
        more[lane] += (a & 3) - (b & 3)
        true, own, step = a >> 2, b >> 2, step + 1
        apart = true != own
        lane, true, own = lane[apart], true[apart], own[apart]
    return more, last


def phrases(symbols: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Phrases of each text; texts lie one after another in ``symbols`` from ``starts``."""
    ends = np.append(starts[1:], len(symbols))
    blocks = -(-(ends - starts) // BLOCK)
    owner = np.repeat(np.arange(len(starts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = starts[owner] + nth * BLOCK
    size = np.minimum(ends[owner] - at, BLOCK)
    last, count = _walk(symbols, at, size, moves)
    own, entry, more = last.copy(), np.zeros_like(last), np.zeros_like(count)
    redo = np.nonzero(nth)[0]
    while len(redo):  # again only for blocks whose predecessor ends otherwise than was thought
        entry[redo] = last[redo - 1]
        more[redo], ended = _carried(symbols, at[redo], size[redo], entry[redo], moves)
        ended = np.where(ended >= 0, ended, own[redo])
        changed = redo[ended != last[redo]]
        last[redo] = ended
        after = changed + 1
        after = after[after < len(owner)]
        redo = after[(nth[after] > 0) & (last[after - 1] != entry[after])]
    total = np.bincount(owner, weights=count + more, minlength=len(starts))
    return total + (last[np.cumsum(blocks) - 1] != 0)  # the phrase that is open at the end


def _symbols(texts: list[str | None], classes: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts, each ended by one blank; their starts; whether each has a letter."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.array([len(t or "") + 1 for t in texts])
    ends = np.cumsum(lengths)
    kinds = classes[points]
    letter = kinds != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[ends - 1] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    seen = np.concatenate([[0], np.cumsum(letter)])
    starts = ends - lengths
    symbols, sizes = spelled(kinds[keep], letters)
    places = at[starts] if sizes is None else np.concatenate([[0], np.cumsum(sizes)])[at[starts]]
    return symbols, places, seen[ends] > seen[starts]


def _predict(batches: Iterator[pa.RecordBatch], sample: tuple[tuple[str, str], ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    langs = [lang for lang, _ in sample]
    alphabet, tables = _model(sample)
    classes = _letter_classes(alphabet)
    for batch in batches:
        ids, folds, texts = (batch.column(k) for k in range(3))
        sizes = np.cumsum([len(t or "") + 1 for t in texts.to_pylist()])
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + BATCH_SYMBOLS)))
            symbols, starts, lettered = _symbols(texts.slice(at, to - at).to_pylist(), classes, len(alphabet))
            names, scores = np.full(to - at, UNKNOWN, dtype=object), np.zeros(to - at)
            if langs:
                cost = np.array([phrases(symbols, starts, moves) * bits for moves, bits in tables])
                best = cost.argmin(axis=0)
                share = 1 / np.maximum(cost, 1e-9) ** 4
                share /= share.sum(axis=0)
                names[lettered] = np.array(langs, dtype=object)[best][lettered]
                scores[lettered] = share.max(axis=0)[lettered]
            columns = [ids.slice(at, to - at), folds.slice(at, to - at), pa.array(names.tolist(), pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            at = to


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred``, ``score``. Held-out rows are never trained on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sample = tuple(sorted(training_sample(docs, ~held_out(id_col), text_col, lang_col).items()))
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    work = partial(_predict, sample=sample, schema=to_arrow_schema(schema))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
