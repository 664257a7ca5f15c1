"""BPE encoding and decoding with a contiguous rank array per word.

A word is a row of parts (token ids) beside the ranks of adjacent pairs. The lowest rank
is searched by a plain scan, its boundary is deleted by moving the rest of the row up, and
the two neighbouring ranks are looked up again. Many words go through this at once, as the
rows of one matrix; words too long for a row use a heap instead, with the same result.

Null text counts as empty and has no ids. Special tokens written out in a text become
their ids, as in the tokenizers library. Repeated rows are encoded alike, each on its own.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from duelframe.llm.common import add_columns, whole_text

NONE = np.int32(2**31 - 1)
#: Widths of the word matrices in bytes; a longer word goes through a heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
#: White space as the tokenizer's patterns mean it; str.split also cuts at \x1c-\x1f.
SPACE = r"\t-\r \x85\xa0  -     　"
CHUNK = regex.compile(f"[^{SPACE}]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Marks that form one word of their own after letters; not ', which may start a suffix.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Encoded chunks and words kept per task; what comes beyond is encoded again in each batch.
CACHED_CHUNKS = 50_000
CACHED_WORDS = 1 << 20
#: Bytes of text taken at once.
SLICE = 1 << 19
#: Kinds of Latin-1 characters in the word pattern: white space, letter, number, other.
WHITE, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> list[str]:
    """The printable letter for each byte, by the usual byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = itertools.count(256)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairTable:
    """Ranks of id pairs in an open-addressing table, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(4, int(len(left) * 8).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        for rank, key in enumerate(((left.astype(np.int64) << 32) | right).tolist()):
            slot = self._slots(np.int64(key))
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, key):
        mixed = (key >> 32) * np.int64(0x9E3779B1) + (key & 0xFFFFFFFF) * np.int64(0x85EBCA77)
        return ((mixed ^ (mixed >> 21)) & ((1 << self.bits) - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for no merge or a negative id."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0) & (left >= 0) & (right >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class WordTable:
    """Ids of known words by 64-bit word hash, in one open-addressing table and one arena."""

    def __init__(self, most: int):
        self.most, self.bits = most, (2 * most - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.begins = np.zeros(1 << 12, np.int64)
        self.counts = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.words = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is unknown."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (keys ^ (keys >> np.uint64(29))) & mask
        rows, here = self.rows[slot], self.keys[slot]
        open_ = np.flatnonzero((rows >= 0) & (here != keys))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
            at = slot[open_]
            rows[open_] = self.rows[at]
            open_ = open_[(self.rows[at] >= 0) & (self.keys[at] != keys[open_])]
        return rows

    def add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Append words to the arena; the row of the first."""
        first, n, end = self.words, self.words + len(counts), self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(end, len(self.ids)), np.int32))
        if n > len(self.counts):
            more = np.zeros(max(n, len(self.counts)), np.int64)
            self.counts, self.begins = np.append(self.counts, more), np.append(self.begins, more)
        self.ids[self.used : end] = ids
        self.counts[first:n] = counts
        self.begins[first:n] = self.used + np.cumsum(counts) - counts
        self.words, self.used = n, end
        return first

    def keep(self, keys: np.ndarray, first: int) -> None:
        """Make distinct new keys known, in rows from `first` on."""
        mask = np.uint64((1 << self.bits) - 1)
        rows = np.arange(first, first + len(keys), dtype=np.int32)
        slot = (keys ^ (keys >> np.uint64(29))) & mask
        while len(keys):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rows[free]  # of several for one slot, the last stays
            mine = self.rows[slot] == rows
            self.keys[slot[mine]] = keys[mine]
            keys, rows, slot = keys[~mine], rows[~mine], (slot[~mine] + np.uint64(1)) & mask


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int32) for i in (0, 1))
        self.pairs = PairTable(left, right)
        self.rank_of = {p: r for r, p in reversed([*enumerate(zip(left.tolist(), right.tolist(), strict=True))])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.word = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        every = [chr(b) for b in range(256)]
        space = regex.compile(f"[{SPACE}]")
        self.kind = np.array([WHITE if space.match(c) else LETTER if c.isalpha() else NUMBER if regex.match(r"\p{N}", c) else OTHER for c in every], np.uint8)
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every], np.uint8)
        random = np.random.default_rng(20)
        self.letters = random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        self.powers = powers(base, 2 * SLICE)
        self.inverse = powers(pow(base, -1, 1 << 64), 2 * SLICE)
        self.known = WordTable(CACHED_WORDS)
        self.cache: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.used, self.chunks = 0, 0

    # words

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        table = np.full((len(words), int(min(sizes.max(initial=1), WIDTHS[-1]))), -1, np.int32)
        counts = np.zeros(len(words), np.int64)
        long_words = {}
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(rows):
                places = ends[rows, None] - sizes[rows, None] + np.arange(width)
                here = np.arange(width) < sizes[rows, None]
                parts = np.where(here, self.inner[raw[np.minimum(places, len(raw) - 1)]], -1)
                parts[np.arange(len(rows)), sizes[rows] - 1] = self.last[raw[ends[rows] - 1]]
                done = self._merge_rows(parts)
                wide = min(width, table.shape[1])
                table[rows, :wide] = done[:, :wide]
                counts[rows] = (done >= 0).sum(axis=1)
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            long_words[i] = self._merge_long(words[i])
            counts[i] = len(long_words[i])
        flat = np.empty(int(counts.sum()), np.int32)
        begins = np.cumsum(counts) - counts
        short = sizes <= WIDTHS[-1]
        within = np.arange(table.shape[1]) < counts[short, None]
        flat_at = (begins[short, None] + np.arange(table.shape[1]))[within]
        flat[flat_at] = table[short][within]
        for i, ids in long_words.items():
            flat[begins[i] : begins[i] + len(ids)] = ids
        return flat, counts

    def _merge_rows(self, parts: np.ndarray) -> np.ndarray:
        out = parts.copy()
        width = parts.shape[1]
        if width < 2:
            return out
        ranks = np.full(parts.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), -1)
        columns = np.arange(width)
        rows = np.arange(len(parts))
        while len(rows):
            at = ranks.argmin(axis=1)
            n = np.arange(len(rows))
            best = ranks[n, at]
            going = best < NONE
            if not going.all():
                out[rows[~going]] = parts[~going]
                rows, parts, ranks, at, best = rows[going], parts[going], ranks[going], at[going], best[going]
                n = np.arange(len(rows))
                if not len(rows):
                    break
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, shift, 1)
            ranks = np.take_along_axis(ranks, shift, 1)
            parts[:, -1] = -1
            ranks[:, -1] = NONE
            new = self.merged[best]
            parts[n, at] = new
            follow = np.where(at + 1 < width, parts[n, np.minimum(at + 1, width - 1)], -1)
            before = np.where(at > 0, parts[n, np.maximum(at - 1, 0)], -1)
            ranks[n, at] = self.pairs.find(new, follow)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.pairs.find(before[some], new[some])
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        ahead, behind = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank_of = self.rank_of
        heap = [(r, i) for i in range(len(ids) - 1) if (r := rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] < 0 or j >= len(ids) or rank_of.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            ahead[i] = k = ahead[j]
            if k < len(ids):
                behind[k] = i
            for a, b in ((behind[i], i), (i, k)):
                if a >= 0 and b < len(ids) and (r := rank_of.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    # texts

    def _words(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk between white space; a special token is its id."""
        core = chunk.rstrip(MARKS)
        if core.isalpha():
            tail = chunk[len(core) :]
            if not core.isascii():
                core = unicodedata.normalize("NFC", core).replace("Σ", "σ")
            if core.isascii() or core.lower().isalpha():  # letters only: one word
                word = core.lower().encode()
                return [word, tail.encode()] if tail else [word]
        out: list[bytes | int] = []
        for piece in self.special_cut.split(chunk) if "<|" in chunk else (chunk,):
            if piece in self.special:
                out.append(self.special[piece])
            else:  # lower case letter by letter: no final sigma
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                out += [w.encode("utf-8") for w in self.word.findall(plain)]
        return out

    def _add(self, chunks: list[str]) -> None:
        """Append the ids of new chunks to the arena."""
        index: dict[bytes, int] = {}
        which, sizes = [], []
        for chunk in chunks:
            words = self._words(chunk)
            sizes.append(len(words))
            which += [-1 - w if isinstance(w, int) else index.setdefault(w, len(index)) for w in words]
        flat, counts = self.encode_words(list(index)) if index else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        flat = np.append(flat, sorted(self.special.values())).astype(np.int32)
        specials = {i: len(index) + k for k, i in enumerate(sorted(self.special.values()))}
        counts = np.append(counts, np.ones(len(specials), np.int64))
        begins = np.cumsum(counts) - counts
        rows = np.fromiter((w if w >= 0 else specials[-1 - w] for w in which), np.int64, len(which))
        ids, per_word = gather(flat, begins[rows], counts[rows]), counts[rows]
        word_ends = np.append(0, np.cumsum(per_word))
        chunk_ends = word_ends[np.append(0, np.cumsum(np.array(sizes, np.int64)))]
        need, entries = self.used + len(ids), self.chunks + len(chunks) + 1
        if need > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(need, np.int32))
        if entries > len(self.starts):
            self.starts = np.append(self.starts, np.zeros(entries, np.int64))
        self.ids[self.used : need] = ids
        self.starts[self.chunks : entries] = self.used + chunk_ends
        self.used, self.chunks = need, entries - 1

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        plain, plain_at, other, other_at = [], [], [], []
        for i, text in enumerate(texts):
            try:
                coded = text.encode("latin-1")
            except UnicodeEncodeError:
                coded = None
            if coded is None or b"'" in coded or b"<|" in coded or len(coded) >= SLICE:
                other.append(text)
                other_at.append(i)
            else:
                plain.append(coded)
                plain_at.append(i)
        pieces, counts = [], np.zeros(len(texts), np.int64)
        group: list[bytes] = []
        for coded in [*plain, None]:
            if group and (coded is None or sum(map(len, group)) + len(coded) + len(group) > SLICE):
                pieces.append(self._encode_latin(group))
                group = []
            if coded is not None:
                group.append(coded)
        if plain:
            counts[plain_at] = np.concatenate([n for _, n in pieces])
        if other:
            pieces.append(self._encode_any(other))
            counts[other_at] = pieces[-1][1]
        flat = np.concatenate([ids for ids, _ in pieces]) if pieces else np.zeros(0, np.int32)
        if not plain or not other:
            return flat, counts
        order = np.array(plain_at + other_at)
        begins = np.empty(len(texts), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return gather(flat, begins, counts), counts

    def _encode_latin(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts in Latin-1 without ' or special tokens: composed already, and cut into words
        by the kinds of their bytes alone."""
        raw = self.lower[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = self.kind[raw]
        edge = np.empty(len(raw), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == NUMBER
        cuts = np.flatnonzero(edge)
        begins, ends = cuts, np.append(cuts[1:], len(raw))
        solid = kind[begins] != WHITE
        begins, ends = begins[solid], ends[solid]
        sums = np.cumsum(self.letters[raw] * self.powers[: len(raw)])
        sums = np.concatenate([np.zeros(1, np.uint64), sums])
        keys = (sums[ends] - sums[begins]) * self.inverse[begins]
        keys ^= (ends - begins).astype(np.uint64) << np.uint64(52)
        rows = self.known.find(keys).astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        kept = self.known.words, self.known.used
        if len(missing):
            fresh, first_at, index = np.unique(keys[missing], return_index=True, return_inverse=True)
            buffer = raw.tobytes().decode("latin-1")
            b, e = begins[missing[first_at]].tolist(), ends[missing[first_at]].tolist()
            words = [buffer[i:j].encode() for i, j in zip(b, e, strict=True)]
            first = self.known.add(*self.encode_words(words))
            rows[missing] = first + index
            if self.known.words <= self.known.most:
                self.known.keep(fresh, first)
                kept = self.known.words, self.known.used
        per_word = self.known.counts[rows]
        ids = gather(self.known.ids, self.known.begins[rows], per_word)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        upto = np.append(0, np.cumsum(per_word))[np.searchsorted(begins, text_ends)]
        self.known.words, self.known.used = kept
        return ids, np.diff(upto, prepend=0)

    def _encode_any(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[str] = []
        sizes = []
        for text in texts:
            found = CHUNK.findall(text) if ODD_SPACE.search(text) else text.split()
            sizes.append(len(found))
            parts += found
        kept_ids, kept_chunks = self.used, self.chunks
        places = np.fromiter(map(self.cache.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            fresh: dict[str, int] = {}
            at = [fresh.setdefault(parts[i], len(fresh)) for i in missing.tolist()]
            places[missing] = np.array(at, np.int64) + self.chunks
            self._add(list(fresh))
            if kept_chunks + len(fresh) <= CACHED_CHUNKS:
                self.cache.update((c, i + kept_chunks) for c, i in fresh.items())
                kept_ids, kept_chunks = self.used, self.chunks
        begins, counts = self.starts[places], self.starts[places + 1] - self.starts[places]
        ids = gather(self.ids, begins, counts)
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(np.array(sizes, np.int64)))]
        self.used, self.chunks = kept_ids, kept_chunks
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids with a space between them; this vocabulary has no decoder
        step that would join them."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def gather(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[b : b + n] for each (b, n), one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins - (ends - counts), counts) + np.arange(total)]


class LibraryBpe(WordBpe):
    """The same, but each word that is not known yet is encoded by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        super().__init__(path)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum())), counts


@functools.lru_cache(maxsize=2)
def library_vocabulary(path: str) -> LibraryBpe:
    return LibraryBpe(path)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """The vocabulary at `path`, read once per Python worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, text: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `n_tokens`, `ids` (little-endian unsigned 32-bit integers) and `decoded`.

    `path` is the vocabulary file, on every executor. Columns of these names are replaced,
    others are kept as they are (only `keep`, if given).
    """

    def work():
        model = vocabulary(path)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            ids, counts = model.encode_batch(columns[0].to_pylist())
            ends = np.cumsum(counts)
            packed, texts = [], []
            for n, e in zip(counts.tolist(), ends.tolist(), strict=True):
                own = ids[e - n : e]
                packed.append(own.astype("<u4").tobytes())
                texts.append(model.decode(own))
            return [pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(texts, pa.string())]

        return compute

    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())]
    return add_columns(docs, [whole_text() if text is None else text], fields, work, keep)
