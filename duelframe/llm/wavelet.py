"""Token ids in binary shards, each one a wavelet matrix.

A shard holds the ids of consecutive documents as bit-planes, highest bit first; each
plane is in the order that the planes above left, zeros before ones. Rank and select on
the planes give the token at a place, the count of a token in a range and the place of
its k-th occurrence without unpacking the rest.

`write_shards` sorts documents by id into ranges, one range a task, and writes shards as
rows of a zstd-compressed Parquet table, so that any file system Spark writes to will do
and a lost task is simply run again. `read_documents` reads them back.

Null text counts as empty and holds only the end id. Documents with equal ids are ordered
by text; a null id comes first. A document longer than a shard gets a shard of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.bpe import library_vocabulary
from duelframe.llm.common import by_bytes, stored, whole_text

#: Tokens in a shard, at least, unless a task's documents end before.
SHARD_TOKENS = 48 << 10
#: Bits of a rank block.
BLOCK = 512
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class WaveletMatrix:
    """Bit-planes of a sequence of unsigned integers below 2 ** bits."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: np.ndarray):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        row = values.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (row & row.dtype.type(1 << bit)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            low = row.compress(~ones)
            zeros.append(len(low))
            row = np.concatenate([low, row.compress(ones)])
        return cls(len(values), bits, np.array(zeros, np.int64), np.array(planes, np.uint8))

    @classmethod
    def load(cls, n: int, zeros: list[int], packed: bytes) -> WaveletMatrix:
        bits = len(zeros)
        planes = np.frombuffer(packed, np.uint8).reshape(bits, -1)
        return cls(n, bits, np.array(zeros, np.int64), planes)

    def pack(self) -> bytes:
        return self.planes.tobytes()

    def values(self) -> np.ndarray:
        """The whole sequence. Short ones: the planes move (place, value so far) pairs down as
        they moved the values; longer ones: the planes are undone from the lowest up."""
        if self.bits <= 16 and self.n <= 1 << 16:
            pairs = np.arange(self.n, dtype=np.uint32) << np.uint32(16)
            for level in range(self.bits):
                ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
                high = pairs.compress(ones) | np.uint32(1 << (self.bits - 1 - level))
                pairs = np.concatenate([pairs.compress(~ones), high])
            out = np.empty(self.n, np.uint16)
            out[pairs >> np.uint32(16)] = pairs.astype(np.uint16)
            return out
        kind = np.uint16 if self.bits <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            z = self.zeros[level]
            above[~ones] = row[:z]
            above[ones] = row[z:] | kind(1 << (self.bits - 1 - level))
            row = above
        return row

    def _rank1(self, level: int, upto: int) -> int:
        """Ones before place `upto` of a plane: a block count and a popcount."""
        if self._ranks is None:
            per_byte = POPCOUNT[self.planes]
            pad = -per_byte.shape[1] % (BLOCK // 8)
            blocks = np.pad(per_byte, ((0, 0), (0, pad))).reshape(self.bits, -1, BLOCK // 8).sum(2, dtype=np.int64)
            self._ranks = [np.append(0, np.cumsum(b)) for b in blocks]
        block = upto // BLOCK
        count = int(self._ranks[level][block])
        first, last = block * BLOCK // 8, upto // 8
        count += int(POPCOUNT[self.planes[level, first:last]].sum())
        if upto % 8:
            count += int(POPCOUNT[self.planes[level, last] & ((1 << upto % 8) - 1)])
        return count

    def access(self, place: int) -> int:
        value = 0
        for level in range(self.bits):
            before = self._rank1(level, place)
            one = self._rank1(level, place + 1) - before
            value = value * 2 + one
            place = int(self.zeros[level]) + before if one else place - before
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of the token in places low to high - 1."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, counted from 0."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        place = low + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = place - int(self.zeros[level]) if one else place
            left, right = 0, self.n - 1  # first place of the plane with want + 1 such bits up to it
            while left < right:
                middle = (left + right) // 2
                ones = self._rank1(level, middle + 1)
                if (ones if one else middle + 1 - ones) > want:
                    right = middle
                else:
                    left = middle + 1
            place = left
        return place


SHARDS = (
    "part int, shard int, n_tokens long, doc_ids array<long>, lengths array<long>, zeros array<long>, planes binary"
)


def write_shards(docs: DataFrame, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode `text` of `docs` with the tokenizers library and the vocabulary at `path`, append `end_id` to each
    document, and store the ids in ascending `doc_id` order; the stored table of shards."""
    ordered = docs.select("doc_id", whole_text().alias("text")).repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library_vocabulary(path)
        bits = max(end_id, len(model.tokens) - 1).bit_length()
        part, shard = TaskContext.get().partitionId(), 0
        ids, lengths, held, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids), bits)
            row = {
                "part": [part], "shard": [shard], "n_tokens": [total], "doc_ids": [held], "lengths": [lengths],
                "zeros": [matrix.zeros.tolist()], "planes": [matrix.pack()],
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=list(row))

        for batch in batches:
            for slice_ in by_bytes(batch):
                flat, counts = model.encode_batch(slice_.column(1).to_pylist())
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                counts = counts + 1
                ends = ends + np.arange(1, len(ends) + 1)
                keys = slice_.column(0).to_pylist()
                first = 0
                while first < len(counts):  # whole documents until the shard is full
                    begin = int(ends[first] - counts[first])
                    last = int(np.searchsorted(ends, begin + shard_tokens - total))
                    last = min(last + 1, len(counts))
                    ids.append(flat[begin : int(ends[last - 1])])
                    lengths += counts[first:last].tolist()
                    held += keys[first:last]
                    total += len(ids[-1])
                    first = last
                    if total >= shard_tokens:
                        yield flush()
                        ids, lengths, held, total = [], [], [], 0
                        shard += 1
        if held:
            yield flush()

    return stored(ordered.mapInArrow(run, SHARDS), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document of stored shards: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32, from the ids in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = WaveletMatrix.load(row["n_tokens"], row["zeros"], row["planes"]).values().astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - np.array(row["lengths"])
                sums = [zlib.crc32(ids[b:e].tobytes()) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(begins, pa.int64()),
                        pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    read = shards.mapInArrow(run, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("part").orderBy("shard")
    inside = sizes.select("part", "shard", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("_inside"))
    offsets = inside.join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_inside")).alias("_first"))
    start = (F.col("_first") + F.col("within")).alias("start")
    return read.join(offsets, ["part", "shard"]).select("doc_id", start, "n_tokens", "ids_crc32")
