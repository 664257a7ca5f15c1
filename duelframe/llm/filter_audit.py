"""Audit of how quality filters interact.

A table-driven transducer reads each text once, byte by byte: its states tell blank, word and
the bytes still missing of a character, its output marks word borders, characters, capitals
and symbols. Word spans go into an open hash table, and an entry counts as the same word only
if its bytes are the same. Each document becomes the set of the filters that it fails, the sets
are counted, and every order of the filters is played on the counts.

Awkward rows: null text is empty; null and empty texts are copies of each other; a row without
an id has no smaller id and is none; repeated ids and repeated label rows are allowed (a label
holds if any of its rows says so); an empty table gives no rows; a stray continuation byte is a
character of its own; other columns may have any name.
"""

from __future__ import annotations

import zlib
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from duelframe.llm.common import add_columns, stored, whole_text
from duelframe.llm.wordhash import SEPARATORS, mix

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Longer texts are read in pieces of about so many bytes, cut between words.
PIECE = 8 << 20
#: Words up to so many bytes are hashed and compared eight bytes at a time.
SHORT = 64

# States, and marks that a byte puts out.
BLANK, INSIDE, WANT1, WANT2, WANT3 = range(5)
BEGIN, CHARACTER, CAPITAL, SYMBOL, END = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for each state and byte."""
    after, marks = np.zeros((5, 256), np.uint8), np.zeros((5, 256), np.uint8)
    for state in range(5):
        for byte in range(256):
            blank, more = byte in SEPARATORS, 0x80 <= byte < 0xC0
            if blank:
                after[state, byte] = BLANK
            elif byte < 0x80 or more:
                after[state, byte] = state - 1 if more and state > INSIDE else INSIDE
            else:
                after[state, byte] = WANT1 + (byte >= 0xE0) + (byte >= 0xF0)
            mark = BEGIN if state == BLANK and not blank else 0
            mark |= END if state != BLANK and blank else 0
            mark |= 0 if more and state > INSIDE else CHARACTER
            mark |= CAPITAL if 65 <= byte <= 90 else 0
            marks[state, byte] = mark | (SYMBOL if byte in SYMBOLS else 0)
    return after, marks


AFTER, MARKS = _tables()


def marks_of(raw: np.ndarray) -> np.ndarray:
    """The transducer's marks for each byte, starting from a blank.

    A byte that is no continuation sets the state by itself, so all bytes step at once; after
    three more steps of the continuation bytes every state is the one that a walk from the first
    byte gives, since from the fourth continuation byte on the state is that of a word.
    """
    states = AFTER[BLANK][raw]
    follow = np.flatnonzero((raw & 0xC0) == 0x80)
    for _ in range(3 if len(follow) else 0):
        before = np.where(follow > 0, states[follow - 1], BLANK)
        states[follow] = AFTER[before, raw[follow]]
    return MARKS[np.concatenate([np.array([BLANK], np.uint8), states[:-1]]), raw]


def _eights(padded: np.ndarray, begins: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    """Bytes `at` to `at + 7` of each span as one number, zeros behind its end."""
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    missing = np.clip(at + 8 - lengths, 0, 7).astype(np.uint64) * np.uint64(8)
    return (view[begins + at] << missing) >> missing


def _hashes(padded: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = mix(lengths.astype(np.uint64))
    short = np.flatnonzero(lengths <= SHORT)
    for at in range(0, SHORT, 8):
        short = short[lengths[short] > at]
        if not len(short):
            break
        out[short] = mix(out[short] ^ _eights(padded, begins[short], lengths[short], at))
    for i in np.flatnonzero(lengths > SHORT):
        out[i] ^= np.uint64(zlib.crc32(padded[begins[i] : begins[i] + lengths[i]]) << 20)
    return out


def _same(padded: np.ndarray, begins: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Are spans `a` and `b`, of equal lengths, equal byte for byte?"""
    good = np.ones(len(a), bool)
    left = np.flatnonzero(lengths[a] <= SHORT)
    for at in range(0, SHORT, 8):
        left = left[lengths[a[left]] > at]
        if not len(left):
            break
        x, y = a[left], b[left]
        good[left] &= _eights(padded, begins[x], lengths[x], at) == _eights(padded, begins[y], lengths[y], at)
    for i in np.flatnonzero(lengths[a] > SHORT):
        x, y, n = begins[a[i]], begins[b[i]], lengths[a[i]]
        good[i] = np.array_equal(padded[x : x + n], padded[y : y + n])
    return good


def distinct_spans(padded: np.ndarray, begins: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Indices of one span for each different word of each owner. All spans probe an open
    hash table at once; those that met neither a free place nor their own word go one on."""
    hashes = mix(_hashes(padded, begins, lengths) ^ mix(owners.astype(np.uint64)))
    room = 1 << max(4, int(2 * len(begins)).bit_length())
    table = np.full(room, -1, np.int64)
    place = (hashes & np.uint64(room - 1)).astype(np.int64)
    waiting = np.arange(len(begins))
    while len(waiting):
        free = waiting[table[place[waiting]] < 0]
        table[place[free]] = free
        there = table[place[waiting]]
        done = there == waiting
        alike = np.flatnonzero(~done & (hashes[there] == hashes[waiting]) & (owners[there] == owners[waiting]) & (lengths[there] == lengths[waiting]))
        done[alike] = _same(padded, begins, lengths, waiting[alike], there[alike])
        waiting = waiting[~done]
        place[waiting] = (place[waiting] + 1) & (room - 1)
    return table[table >= 0]


def _scan(texts: list[bytes]):
    """Sums of the marks per text, and the spans of its different words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    # A line feed ends each text; eight more bytes let the last span be read in eights.
    padded = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
    raw = padded[:-8]
    ends_at = np.cumsum(sizes)
    starts = ends_at - sizes
    marks = marks_of(raw)
    total = lambda mark: np.add.reduceat((marks & mark) > 0, starts, dtype=np.int64)
    begins = np.flatnonzero(marks & BEGIN)
    lengths = np.flatnonzero(marks & END) - begins
    owners = np.searchsorted(ends_at, begins, "right")
    spans = distinct_spans(padded, begins, lengths, owners)
    counts = {
        "n_words": np.bincount(owners, minlength=len(texts)),
        "n_distinct": np.bincount(owners[spans], minlength=len(texts)),
        "n_capitals": total(CAPITAL),
        "n_points": total(CHARACTER) - 1,
        "n_symbols": total(SYMBOL),
    }
    return counts, padded, begins[spans], lengths[spans]


def _pieces(text: bytes):
    """A long text in pieces cut before a separator."""
    start = 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and text[end] not in SEPARATORS:
            end += 1
        yield text[start:end]
        start = end


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_points and n_symbols of each text."""
    out = _scan([t if len(t) <= PIECE else b"" for t in texts])[0] if texts else {}
    for i, text in enumerate(texts):
        if len(text) <= PIECE:
            continue
        words = set()
        for piece in _pieces(text):
            counts, padded, begins, lengths = _scan([piece])
            words.update(padded[b : b + n].tobytes() for b, n in zip(begins, lengths, strict=True))
            for name, values in counts.items():
                out[name][i] += values[0]
        out["n_distinct"][i] = len(words)
    return out


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the counts of its column `text`."""

    def work():
        def compute(columns):
            found = measure_texts(columns[0].to_pylist())
            return [pa.array(found[c] if found else [], pa.int64()) for c in COUNTS]

        return compute

    return add_columns(docs, [whole_text().cast("binary")], [StructField(c, LongType()) for c in COUNTS], work, keep)


def text_filters() -> dict[str, Column]:
    """What a text itself can fail, by letter."""
    return {
        "A": F.col("n_words") < MIN_WORDS,
        "B": F.col("n_distinct") * 100 < F.col("n_words") * MIN_DISTINCT,
        "C": F.col("n_capitals") * 100 > F.col("n_points") * MAX_CAPITALS,
        "D": F.col("n_symbols") > 0,
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails the i-th of LETTERS), documents, good, toxic.

    Equal texts are met by their sha256. Copies are counted before and after the shuffle, and
    only counts by (text, part, label) come together for a text: no task holds its copies.
    """
    mask = sum((F.when(c, 1 << LETTERS.index(letter)).otherwise(0) for letter, c in text_filters().items()), F.lit(0))
    base = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole_text().cast("binary"), 256)).alias("digest"),
        whole_text().alias("text"),
    )
    measured = measure(base, ["doc_id", "part", "digest"]).select("doc_id", "part", "digest", mask.alias("mask"))
    rows = stored(measured.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("rows")), "audit")

    marked = labels.where("doc_id is not null").groupBy("doc_id")
    marked = marked.agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    known = rows.where("doc_id is not null").join(marked, "doc_id", "left")
    known = known.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    unknown = rows.where("doc_id is null").withColumns({"good": no, "toxic": no})

    each = ["digest", "part", "mask", "good", "toxic"]
    # Copies of one text: how many rows, how many of them without an id or with the least one.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))).alias("first")
    free = F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("free")
    by_id = known.unionByName(unknown.select(known.columns)).groupBy("doc_id", *each).agg(F.sum("rows").alias("rows"))
    texts = by_id.groupBy(*each).agg(F.sum("rows").alias("rows"), first, free)
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("firsts", F.col("free") + F.when(F.col("first.doc_id") == least, F.col("first.rows")).otherwise(0))
    copy = 1 << LETTERS.index("E")
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("rows")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("rows") - F.col("firsts")).alias("rows")),
    )
    flat = texts.select("part", "good", "toxic", F.inline(both))
    counted = lambda when: F.sum(F.when(when, F.col("rows")).otherwise(0))
    return flat.groupBy("part", "mask").agg(
        F.sum("rows").alias("documents"), counted(F.col("good")).alias("good"), counted(F.col("toxic")).alias("toxic")
    )


def _play(group: pd.DataFrame) -> pd.DataFrame:
    """Every order of the filters on one part's counts, at most 32 rows."""
    masks = group["mask"].to_numpy()
    documents, good, toxic = (group[c].to_numpy() for c in ("documents", "good", "toxic"))
    rows, won = [], dict.fromkeys(LETTERS, 0)
    for order in permutations(LETTERS):
        earlier = np.zeros(len(masks), bool)
        for step, letter in enumerate(order, 1):
            fails = (masks >> LETTERS.index(letter) & 1) > 0
            here = fails & ~earlier
            redundant = documents[fails & earlier].sum()
            earlier = earlier | fails
            alone = documents[masks == 1 << LETTERS.index(letter)].sum()
            won[letter] += documents[here].sum()
            rows.append(
                ("".join(order), step, documents[~earlier].sum(), documents[here].sum(), redundant, alone, good[here].sum(), toxic[here].sum())
            )
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    out = pd.DataFrame(rows, columns=names)
    out["shapley"] = [won[order[step - 1]] for order, step in zip(out["filter_order"], out["step"], strict=True)]
    out.insert(0, "part", group["part"].iloc[0])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source), order of the filters and step: see `_play`."""
    counts = failure_counts(docs, labels)
    schema = (
        "part string, filter_order string, step int, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long"
    )
    return counts.groupBy("part").applyInPandas(_play, schema)
