"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words with one blank between. An item of m characters may
differ from a passage in k = floor(m * EDIT_SHARE) edits. Cut into k + 1 pieces, at least
one piece is in the passage unchanged: an Aho-Corasick automaton finds all piece hits of a
document in one scan, and Myers' bit-parallel distance verifies the stretch around them.

Items come in blocks of `BLOCK_ITEMS` so that the automaton stays small; each block is one
pass over the documents. An item of fewer than `MIN_WORDS` words matches without edits and
only as whole words, anywhere in a text; null and empty items match nothing, null documents
match nothing. Equal items are all reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from duelframe.llm.common import add_columns

EDIT_SHARE = 0.06
MIN_WORDS = 5
BLOCK_ITEMS = 20_000
#: In place of a piece's place: the piece is a short item as a whole.
WHOLE = -1
WORD = re.compile(r"[^\W_]+")
#: Latin-1 bytes to lower-case letters and digits, everything else to a blank.
PLAIN = bytes(ord(c) if (c := chr(b).lower()).isalnum() and ord(c) < 256 else 32 for b in range(256))


def normal(text: str | None) -> str:
    """Lower-case words with one blank between."""
    if not text:
        return ""
    try:
        return b" ".join(text.encode("latin-1").translate(PLAIN).split()).decode("latin-1")
    except UnicodeEncodeError:
        return " ".join(WORD.findall(text.lower()))


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece): budget + 1 pieces of about equal length."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, text: str):
        self.m = len(text)
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """Least edit distance between the item and any stretch of `text`."""
        plus, minus, score = self.full, 0, self.m
        best, full, top, get = self.m, self.full, self.top, self.bits.get
        for c in text:
            eq = get(c, 0)
            x = eq | minus
            d = (((eq & plus) + plus) ^ plus) | eq | minus
            h_plus, h_minus = minus | (full & ~(d | plus)), plus & d
            if h_plus & top:
                score += 1
            elif h_minus & top:
                score -= 1
                if score < best:
                    best = score
            h_plus = h_plus << 1 & full
            plus = (h_minus << 1 | (full & ~(x | h_plus))) & full
            minus = h_plus & x
        return best


@dataclass
class Items:
    ids: list[int]
    texts: list[str]
    share: float


class Matcher:
    """Finds the items of a block in normalised documents."""

    def __init__(self, items: Items):
        self.ids, self.texts = items.ids, items.texts
        self.budgets = [int(len(t) * items.share) if t.count(" ") + 1 >= MIN_WORDS else 0 for t in items.texts]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (text, budget) in enumerate(zip(items.texts, self.budgets, strict=True)):
            if text.count(" ") + 1 < MIN_WORDS:
                found.setdefault(f" {text} ", []).append((i, WHOLE))
            else:
                for place, piece in pieces(text, budget):
                    found.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.some = bool(found)
        self.patterns: dict[int, Pattern] = {}

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of the items in a normalised text, by id."""
        whole: set[int] = set()
        found = []
        stretches: dict[int, list[list[int]]] = {}
        if self.some and text:
            # Short items are looked for with their borders; places are those of `text`.
            for end, (size, uses) in self.automaton.iter(f" {text} "):
                end -= 1
                for i, place in uses:
                    if place == WHOLE:
                        whole.add(i)
                        continue
                    budget = self.budgets[i]
                    begin = max(0, end + 1 - size - place - budget)
                    stop = end + 1 - size - place + len(self.texts[i]) + budget
                    own = stretches.setdefault(i, [])
                    if own and begin <= own[-1][1] and own[-1][0] <= begin:
                        own[-1][1] = max(own[-1][1], stop)
                    else:
                        own.append([begin, stop])
        for i, own in stretches.items():
            best = min(self._distance(i, text[a:b]) for a, b in own)
            if best <= self.budgets[i]:
                found.append((self.ids[i], best))
        return sorted(found + [(self.ids[i], 0) for i in whole])

    def _distance(self, i: int, text: str) -> int:
        if self.texts[i] in text:
            return 0
        if i not in self.patterns:
            self.patterns[i] = Pattern(self.texts[i])
        return self.patterns[i].distance(text)


def find_items(
    docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, text: Column | None = None, keep: list[str] | None = None
) -> DataFrame:
    """`docs` (or its columns `keep`) with `item_ids` and `distances`: the benchmark items
    (`item_id`, `text`) found in each text, by id, and their least edit distances."""
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text is not null")
    blocks = -(-rows.count() // BLOCK_ITEMS)
    fields = [StructField("item_ids", ArrayType(LongType())), StructField("distances", ArrayType(IntegerType()))]
    source = F.col("text").cast("string") if text is None else text
    base = docs if keep is None else docs.select(*keep, source.alias("text"))
    source = source if keep is None else F.col("text")
    found = base.withColumn("item_ids", F.array().cast("array<long>")).withColumn("distances", F.array().cast("array<int>"))
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        held = [(r.item_id, t) for r in own.collect() if (t := normal(r.text))]
        shared = spark.sparkContext.broadcast(Items([i for i, _ in held], [t for _, t in held], share))
        found = add_columns(found, [source, F.col("item_ids"), F.col("distances")], fields, _worker(shared))
    return found if keep is None else found.select(*keep, "item_ids", "distances")


def _worker(shared):
    def work():
        matcher = Matcher(shared.value)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            ids, distances = [], []
            for text, i, d in zip(*(c.to_pylist() for c in columns), strict=True):
                pairs = sorted([*zip(i, d, strict=True), *matcher.match(normal(text))])
                ids.append([p[0] for p in pairs])
                distances.append([p[1] for p in pairs])
            return [pa.array(ids, pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.int32()))]

        return compute

    return work


def brute_force(item: str, text: str) -> int:
    """Least edit distance of an item and any stretch of a text, by dynamic programming."""
    row = np.arange(len(item) + 1)
    best = int(row[-1])
    for c in text:
        new = row.copy()
        new[0] = 0
        for i, x in enumerate(item, 1):
            new[i] = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c))
        row, best = new, min(best, int(new[-1]))
    return best
