"""Language identification by cross-parsing.

For each language, a suffix automaton holds every substring of a sample of its labelled
text. A text is cut greedily into the longest pieces that the automaton knows; the fewer
pieces per letter, weighed by the log of the sample's length, the closer the language. The
automaton with restarts is one transition table, so that thousands of text segments step
through it together.

Text is lower-cased, runs of anything but letters are one blank. Every letter of the
samples is told apart: where one symbol each does not reach, a letter is written in two or
three, each from a range of its own. Long texts are parsed in
segments of `SEGMENT` symbols, all of them; a segment ends a piece. Null text and text
without a letter are `und` with score 0. Of languages that need equally many pieces, the
alphabetically first wins. Repeated rows get equal answers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from duelframe.llm.common import add_columns

UNKNOWN = "und"
#: Bounds of the training sample, per language: documents, characters of one, letters in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LETTERS = 100, 2_000, 40_000
SEGMENT = 256
#: Symbols: none (after a segment's end), blank, letters outside the samples, then letters.
NONE, BLANK, STRANGE = 0, 1, 2
#: Symbols that letters are written in, at most.
MOST_SYMBOLS = 255 - STRANGE


@dataclass
class LanguageModel:
    languages: list[str]
    letters: str
    tables: list[np.ndarray]
    #: Bits per piece: log2 of the sample's length.
    weights: list[float]


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions [state, symbol] of the automaton of all substrings; -1: none."""
    ahead: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(ahead)
        ahead.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in ahead[p]:
            ahead[p][c] = new
            p = link[p]
        if p >= 0:
            q = ahead[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(ahead)
                ahead.append(dict(ahead[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and ahead[p].get(c) == q:
                    ahead[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(ahead), size), -1, np.int32)
    for state, row in enumerate(ahead):
        for c, to in row.items():
            table[state, c] = to
    return table


def restarting(table: np.ndarray) -> np.ndarray:
    """Entries (next row offset * 2 + 1 if a new piece starts here), flat."""
    size = table.shape[1]
    fresh = np.maximum(table[0], 0)
    goes = np.where(table >= 0, table * size, fresh * size)
    out = goes * 2 + (table < 0)
    out[0] = fresh * size * 2 + 1  # the first letter starts a piece
    out[:, STRANGE] = 1  # a piece of its own
    out[:, NONE] = 0
    return out.astype(np.int32).ravel()


def symbols_of(text: str, table: np.ndarray, most: int | None = None) -> np.ndarray:
    """Symbols of the text, or of its first `most` letters and blanks, runs of blanks made one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = table[points]
    blank = found[:, 0] == BLANK
    found = found[np.append(True, ~blank[1:] | ~blank[:-1])[: len(found)]][:most].ravel()
    return found if table.shape[1] == 1 else found[found != NONE]


def code_shape(letters: int) -> tuple[int, int]:
    """How many symbols a letter is written in, and how many each place can have."""
    width, base = 1, max(letters, 1)
    while width * base > MOST_SYMBOLS:
        width, base = width + 1, 1
        while base**width < letters:
            base += 1
    return width, base


def symbol_table(letters: str) -> np.ndarray:
    """Symbols [code point, place] of each code point, filled up with NONE."""
    width, base = code_shape(len(letters))
    table = np.zeros((0x110000, width), np.uint8)
    table[:, 0] = np.fromiter((STRANGE if chr(i).isalpha() else BLANK for i in range(0x110000)), np.uint8, 0x110000)
    for i, c in enumerate(letters):
        table[ord(c)] = [STRANGE + 1 + k * base + i // base ** (width - 1 - k) % base for k in range(width)]
    return table


def fit(labelled: DataFrame, label: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Learn from a bounded sample of `labelled`: for each label the documents with the
    smallest hash of their key, each cut to SAMPLE_CHARS. Null labels or texts are skipped."""
    rows = labelled.select(F.col(label).cast("string").alias("lang"), F.col("text").cast("string").alias("text"), key)
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'").select(
        "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), F.xxhash64(key, "text").alias("_h")
    )
    best = rows.withColumn("_i", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text")))
    sample = best.where(F.col("_i") <= SAMPLE_DOCS).orderBy("lang", "_i").select("lang", "text").collect()
    texts: dict[str, list[str]] = {}
    for row in sample:
        texts.setdefault(row.lang, []).append(row.text)
    letters = "".join(sorted({c for t in texts.values() for x in t for c in x.lower() if c.isalpha()}))
    table = symbol_table(letters)
    width, base = code_shape(len(letters))
    tables, weights = [], []
    for lang in sorted(texts):
        symbols = symbols_of(" ".join(texts[lang]), table, SAMPLE_LETTERS).tolist()
        tables.append(restarting(suffix_automaton(symbols, STRANGE + 1 + width * base)))
        weights.append(math.log2(len(symbols) + 1))
    return LanguageModel(sorted(texts), letters, tables, weights)


class Parser:
    """A model ready to parse batches of texts."""

    def __init__(self, model: LanguageModel):
        self.model, self.table = model, symbol_table(model.letters)

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol [text, language], and which texts have a letter at all."""
        rows = [symbols_of(t or "", self.table) for t in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        has = np.fromiter((bool(len(r)) and bool((r != BLANK).any()) for r in rows), bool, len(rows))
        segments = -(-sizes // SEGMENT)
        first = np.cumsum(segments) - segments
        grid = np.zeros(int(segments.sum()) * SEGMENT, np.uint8)
        flat = np.concatenate(rows) if rows else grid
        begins = np.cumsum(sizes) - sizes
        grid[np.arange(len(flat)) + np.repeat(first * SEGMENT - begins, sizes)] = flat
        columns = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
        owner = np.repeat(np.arange(len(rows)), segments)
        out = np.zeros((len(rows), len(self.model.tables)))
        for k, (table, weight) in enumerate(zip(self.model.tables, self.model.weights, strict=True)):
            state = np.zeros(columns.shape[1], np.int32)
            pieces = np.zeros(columns.shape[1], np.int32)
            for column in columns:
                state += column
                state = table.take(state)
                pieces += state & 1
                state >>= 1
            out[:, k] = np.bincount(owner, pieces, len(rows)) * weight / np.maximum(sizes, 1)
        return out, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rates, has = self.rates(texts)
        if not self.model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        best = rates.argmin(axis=1)
        shares = np.exp2(rates.min(axis=1, keepdims=True) - rates)
        score = np.where(has, 1 / shares.sum(axis=1), 0.0)
        names = [self.model.languages[i] if h else UNKNOWN for i, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, score.tolist()


def identify(docs: DataFrame, model: LanguageModel, text: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `lang_pred` and `score`, the weight of the
    language among all learned ones. The model goes to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        parser = Parser(shared.value)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            names, scores = parser.predict(columns[0].to_pylist())
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return compute

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return add_columns(docs, [F.col("text").cast("string") if text is None else text], fields, work, keep)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 3 == 1
