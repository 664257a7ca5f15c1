"""Exact similarity join on word n-grams as a blocked sparse matrix product.

Rows of the incidence matrix are documents (equal rows are one), columns are n-grams by
64-bit hash. Two rows of sizes a and b whose Jaccard similarity is at least `t` differ in
at most (a + b)(1 - t)/(1 + t) columns. Columns are therefore cut into more blocks than
that, by hash and size class: linked rows are equal in at least one block, and a row of
the candidate table is (block's content, document). With some blocks more, each row leaves
out as many of those with the fewest columns, in which rows without a link meet most often.

Rows that meet are gathered around the one that meets most others. How many columns each
row has in some hundred buckets bounds the overlap of two rows from above; a group falls
apart into the parts that this bound, set against the one that their sizes set, leaves
together, and rows left alone go. Each part is then
multiplied, block of columns by block of columns, adding up overlap counts; pairs below the
bound that their sizes set are dropped, and what leaves the task is a spanning tree of the
links, not the pairs. Groups above `GROUP` rows are first compared with their middle row
only; Jaccard distance being a metric, rows close to the middle are linked to each other
already, rows far from it cannot link with those, and only the rest is multiplied in
pieces. Block keys are dealt by range over (key, row), which splits a key of any size, and
in passes, so that only a share of them is in shuffle files at a time. Texts are shuffled
once, for groups of any size.

Words are split at the six ASCII separators, A-Z count as a-z. A text with fewer words than
an n-gram has one column, its whole sequence; null, empty and wordless texts have none and
link with nothing. Rows without an id take part through equal rows that have one; without
any, their component is null. Rows that repeat an id are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from duelframe.llm.common import add_columns, forget_since, stored, whole_text, written_so_far
from duelframe.llm.components import components
from duelframe.llm.wordhash import mix, shingle_sets

#: Ratio of the size classes that share a number of blocks.
CLASS_RATIO = 1.3
#: Share of extra blocks; each row leaves out as many, those of the fewest columns.
SLACK = 0.06
#: Rows multiplied at once, and columns per block of the product.
GROUP, COLUMNS = 1_024, 8_192
#: Passes in which the block keys are dealt.
PASSES = 4
#: Rows of a group held against each other by their bucket counts in one task, and the
#: logarithm of the most buckets.
SIFTED, MOST_BITS = 4_096, 12


def weight(size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order in which blocks are left out: fewest columns first, then by key. Equal blocks
    of two rows weigh the same, and no two blocks of a row do unless by collision."""
    most = np.uint64(255)
    return np.minimum(size.astype(np.uint64), most) << np.uint64(56) | key >> np.uint64(8)


def block_keys(row: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a row's column blocks, for its own size class and, if a linked row may be in
    the next one, for that too. A row leaves out its `extra` lightest blocks: linked rows are
    equal in more than `extra` blocks, and the heaviest of these is left out by neither."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    own = int(math.log(n) / math.log(CLASS_RATIO) + 1e-9)
    largest = 100 * n // percent
    keys = []
    for c in range(own, int(math.log(largest) / math.log(CLASS_RATIO) + 1e-9) + 1):
        top = math.floor(CLASS_RATIO ** (c + 1)) + 1  # no row of the class is larger
        most = 2 * top * (100 - percent) // (100 + percent)
        extra = int(SLACK * most)
        blocks = most + 1 + extra
        place = ((row >> np.uint64(11)) % np.uint64(blocks)).astype(np.int64)
        size = np.bincount(place, minlength=blocks)
        order = np.argsort(place, kind="stable")
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(row)[order]))
        ends = np.cumsum(size)
        content = sums[ends] - sums[ends - size]
        seed = (np.arange(blocks, dtype=np.uint64) << np.uint64(32)) + np.uint64(c * 1_000_003 + 17)
        key = mix(mix(seed) ^ content)
        keys.append(key[np.argpartition(weight(size, key), extra)[extra:]] if extra else key)
    return np.concatenate(keys).view(np.int64)


def bucket_counts(row: np.ndarray) -> bytes:
    """How many columns fall into each of 2, 4, 8, ... buckets, an eighth to a quarter as many
    as columns; modulo 16, two to a byte."""
    bits = min(max(int(len(row) - 1).bit_length() - 3, 1), MOST_BITS)
    counts = np.bincount((row >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 15
    return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def folded(counts: bytes, width: int) -> np.ndarray:
    """Bucket counts in `width` buckets, in the upper half of each byte, where they are
    subtracted modulo 16."""
    packed = np.frombuffer(counts, np.uint8)
    flat = np.stack([packed << 4, packed & 240], axis=1).reshape(width, -1)
    return flat.sum(axis=1, dtype=np.uint8)


def differing(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least number of columns in which rows i and j of `table` (folded counts) differ."""
    weight = np.full(table.shape[1], 1 / 16, np.float32)
    step = max(1, (1 << 22) // table.shape[1])
    out = np.empty(len(i), np.float32)
    for k in range(0, len(i), step):
        gaps = table[i[k : k + step]] - table[j[k : k + step]]
        out[k : k + step] = np.abs(gaps.view(np.int8)).view(np.uint8).astype(np.float32) @ weight
    return out


def meetings(keys: list[np.ndarray]) -> np.ndarray:
    """Which two rows have a key in common."""
    met = np.zeros((len(keys), len(keys)), bool)
    flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    many = np.diff(np.append(starts, len(flat)))
    two = starts[many == 2]
    met[owner[two], owner[two + 1]] = True
    for start, n in zip(starts[many > 2].tolist(), many[many > 2].tolist(), strict=True):
        rows = owner[start : start + n]
        met[np.ix_(rows, rows)] = True
    return met


def bound_parts(sizes: np.ndarray, counts: list[bytes], keys: list[np.ndarray], percent: int) -> np.ndarray:
    """A part number for each row, rows being in order of size. Rows with a key in common lie in
    different parts only if they cannot reach the similarity: they differ in more columns
    than it allows, the difference being no less than that of their bucket counts."""
    part = np.arange(len(sizes))
    width = np.array([2 * len(c) for c in counts])
    ends = np.searchsorted(sizes, 100 * sizes // percent, side="right")
    met = meetings(keys)
    for level in np.unique(width):
        own = np.flatnonzero(width == level)
        first, last = own[0], max(ends[own].max(), own[-1] + 1)
        table = np.stack([folded(c, level) for c in counts[first:last]])
        for start in range(first, own[-1] + 1, 64):
            i, j = np.nonzero(met[start : min(start + 64, own[-1] + 1), :last])
            i += start
            open_ = (j > i) & (j < ends[i]) & (part[i] != part[j])
            i, j = i[open_], j[open_]
            near = (100 + percent) * differing(table, i - first, j - first) <= (100 - percent) * (sizes[i] + sizes[j])
            i, j = i[near], j[near]
            for k in np.unique(i).tolist():
                part[np.isin(part, part[j[i == k]])] = part[k]
    return part


def short_digest(row: np.ndarray) -> int | None:
    """First half of a row's 128-bit digest."""
    return int.from_bytes(xxhash.xxh3_128_digest(row.tobytes())[:8], "little", signed=True) if len(row) else None


def incidence(docs: DataFrame, text: Column, key: str, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, row, id_row, counts, keys): the digest of each document's row, its
    first half as a number, its bucket counts, and its block keys."""

    def work():
        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            rows = shingle_sets(columns[0].cast(pa.binary()).to_pylist(), words)
            digests = [xxhash.xxh3_128_digest(r.tobytes()) if len(r) else None for r in rows]
            keys = [block_keys(r, percent) for r in rows]
            return [
                pa.array([len(r) for r in rows], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([short_digest(r) for r in rows], pa.int64()),
                pa.array([bucket_counts(r) if len(r) else None for r in rows], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ]

        return compute

    fields = [
        StructField("n_shingles", LongType()),
        StructField("row", BinaryType()),
        StructField("id_row", LongType()),
        StructField("counts", BinaryType()),
        StructField("keys", ArrayType(LongType())),
    ]
    base = docs.select(F.col(key).cast("long").alias("doc_id"), text.alias("text"))
    return add_columns(base, [F.col("text")], fields, work, ["doc_id"])


def meeting_rows(rows: DataFrame, turn: int) -> DataFrame:
    """(key, id_row) of the block keys of pass `turn` that more than one row has. Dealt by
    range over key and row, each task streams its sorted part; the first and last key of a
    part may go on in the next one, so they are kept in any case."""
    pairs = rows.select(F.explode("keys").alias("key"), "id_row").where(F.pmod("key", F.lit(PASSES)) == turn)
    dealt = pairs.repartitionByRange("key", "id_row").sortWithinPartitions("key", "id_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, many = True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            row = np.concatenate([held_row, batch.column(1).to_numpy()])
            fresh = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
            key, row = key[fresh], row[fresh]  # equal documents meet once
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            keep = np.repeat(sizes > 1, sizes)
            if first or many:  # the part's first key, or one that was sent in part already
                keep[: sizes[0]] = True
            last = starts[-1]
            done = slice(0, last if len(starts) > 1 else max(len(key) - 1, 0))
            chosen = keep[done]
            if chosen.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[done][chosen]), pa.array(row[done][chosen])], names=["key", "id_row"])
            many = (many or first) if len(starts) == 1 else False
            many = many or len(key) - done.stop < sizes[-1]
            first = first and len(starts) == 1
            held_key, held_row = key[done.stop :], row[done.stop :]
        if len(held_key):
            yield pa.RecordBatch.from_arrays([pa.array(held_key), pa.array(held_row)], names=["key", "id_row"])

    return dealt.mapInArrow(run, "key long, id_row long")


def middles(met: DataFrame) -> DataFrame:
    """(middle, id_row, met, degree): each key's rows around the row that meets most others,
    with the keys through which each belongs there, no more than the row has."""
    degree = met.groupBy("id_row").agg(F.count("*").alias("_d"))
    best = met.join(degree, "id_row").groupBy("key").agg(
        F.max(F.struct("_d", "id_row")).alias("_best"), F.min("id_row").alias("_low"), F.max("id_row").alias("_high")
    )
    best = stored(best.where("_low < _high").select("key", F.col("_best.id_row").alias("middle")), "middles")
    groups = met.join(best, "key").groupBy("middle", "id_row").agg(F.collect_list("key").alias("met"))
    return stored(groups.join(degree.withColumnRenamed("_d", "degree"), "id_row").select("middle", "id_row", "met", "degree"), "groups")


def sift(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(middle, id_row) of the parts of `groups` that bucket counts leave together, each around
    its row of the highest degree. `classes` has the counts (id_row, n, counts). A group above
    SIFTED rows is dealt by bands of size (linked rows lie in one band or in neighbours), a
    band above that in pairs of pieces."""
    task = ["middle", "band", "i", "j"]
    found = groups.hint("shuffle_merge").join(classes.select("id_row", "n"), "id_row")
    found = found.join(groups.groupBy("middle").agg(F.count("*").alias("_rows")), "middle")
    band = F.floor(F.log("n") / math.log(101 / percent)).cast("long")
    bands = F.when(F.col("_rows") <= SIFTED, F.array(F.lit(-1).cast("long"))).otherwise(F.array(band, band + 1))
    found = stored(found.select("middle", "id_row", "met", "degree", F.explode(bands).alias("band")), "banded")
    pieces = F.when(F.count("*") > SIFTED, F.ceil(F.count("*") / (SIFTED // 2))).otherwise(1).cast("long")
    found = found.join(found.groupBy("middle", "band").agg(pieces.alias("_pieces")), ["middle", "band"])
    own = F.pmod("id_row", "_pieces")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    found = found.withColumn("_t", F.explode(pairs)).select("middle", "band", "_t.i", "_t.j", "id_row", "met", "degree")
    dealt = found.hint("shuffle_merge").join(classes, "id_row").select(*task, "n", "id_row", "met", "degree", "counts")
    dealt = dealt.repartition(*task).sortWithinPartitions(*task, "n", "id_row")

    def parts(rows: list[tuple]) -> pa.RecordBatch:
        n, ids, keys, degree, counts = zip(*rows, strict=True)
        ids, degree = np.array(ids), np.array(degree)
        part = bound_parts(np.array(n), list(counts), [np.array(k) for k in keys], percent)
        order = np.lexsort((ids, degree, part))  # each part's last row has its highest degree
        part, ids = part[order], ids[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        many = np.diff(np.append(starts, len(part)))
        middle = np.repeat(ids[np.append(starts[1:], len(part)) - 1], many)
        keep = np.repeat(many > 1, many)
        return pa.RecordBatch.from_arrays([pa.array(middle[keep], pa.int64()), pa.array(ids[keep], pa.int64())], names=["middle", "id_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            for *here, n, row, met, degree, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != task:
                    if len(rows) > 1:
                        yield parts(rows)
                    task, rows = here, []
                rows.append((n, row, met, degree, counts))
        if len(rows) > 1:
            yield parts(rows)

    return stored(dealt.mapInArrow(run, "middle long, id_row long").distinct(), "sifted")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all sets, added up over blocks of columns that two sets share."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[low:high], column[low:high] - start] = 1
        total += block @ block.T
    return total.astype(np.int64)


def linked(sizes: np.ndarray, counts: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs reach the similarity: the bound on the overlap follows from the sizes."""
    return 100 * counts >= percent * (sizes[:, None] + other[None, :] - counts)


def tree(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (first of its part, member) that connect what a link matrix connects."""
    edges = []
    open_ = np.ones(len(link), bool)
    for i in range(len(link)):
        if not open_[i]:
            continue
        part = np.zeros(len(link), bool)
        part[i] = True
        grown = link[i] & open_
        while (grown & ~part).any():
            new = grown & ~part
            part |= new
            grown = link[new].any(axis=0) & open_
        open_ &= ~part
        edges += [(i, j) for j in np.flatnonzero(part).tolist() if j != i]
    return edges


def product(tasks: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of the rows (task columns, doc_id, grams) that each task holds."""
    names = ["middle", "i", "j"]
    dealt = tasks.select(*names, "doc_id", "id_row", "grams").repartition(*names)
    dealt = dealt.sortWithinPartitions(*names, "doc_id", "id_row")

    def links(ids: list[int], grams: list[bytes]) -> pa.RecordBatch:
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        sizes = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]])
            edges = [(0, 1)] if linked(sizes[:1], both[:, 1:], sizes[1:], percent)[0, 0] else []
        else:
            edges = tree(linked(sizes, overlaps(sets), sizes, percent)) if len(sets) > 1 else []
        a, b = [ids[i] for i, _ in edges], [ids[j] for _, j in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, ids, grams = None, None, [], []
        for batch in batches:
            for *here, doc, row, gram in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != task:
                    if len(ids) > 1:
                        yield links(ids, grams)
                    task, last, ids, grams = here, None, [], []
                if (doc, row) != last:  # a repeated row counts once
                    last = (doc, row)
                    ids.append(doc)
                    grams.append(gram)
        if len(ids) > 1:
            yield links(ids, grams)

    return dealt.mapInArrow(run, "a long, b long")


def overlap_with_middle(pairs: DataFrame) -> DataFrame:
    """`pairs` (grams, middle_grams) with `overlap`."""

    def work():
        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            sets = zip(*(c.to_pylist() for c in columns), strict=True)
            counts = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in sets]
            return [pa.array(counts, pa.int64())]

        return compute

    keep = [c for c in pairs.columns if c not in ("grams", "middle_grams")]
    return add_columns(pairs, [F.col("grams"), F.col("middle_grams")], [StructField("overlap", LongType())], work, keep)


def with_grams(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """`members` (doc_id, id_row, more) with `n` and `grams`, computed from the texts of
    `docs` again. The join is by shuffle at any size, so its cost grows evenly."""

    def work():
        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            sets = shingle_sets(columns[0].cast(pa.binary()).to_pylist(), words)
            own = [short_digest(s) == i for s, i in zip(sets, columns[1].to_pylist(), strict=True)]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.tobytes() if o else None for s, o in zip(sets, own, strict=True)], pa.binary()),
            ]

        return compute

    found = docs.hint("shuffle_merge").join(members, "doc_id")
    fields = [StructField("n", LongType()), StructField("grams", BinaryType())]
    made = add_columns(found, [F.col("text"), F.col("id_row")], fields, work, [c for c in found.columns if c != "text"])
    return made.where("grams is not null")


def group_edges(groups: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges of all groups (middle, id_row, doc_id) of rows of `docs` (doc_id, text)."""
    sizes = groups.groupBy("middle").agg(F.count("*").alias("_rows"))
    sized = stored(groups.join(sizes, "middle"), "sized")
    zero = F.lit(0).cast("long")
    plain = F.col("_rows") <= GROUP
    members = sized.groupBy("doc_id", "id_row").agg(
        F.collect_list(F.when(plain, F.col("middle"))).alias("middles"), F.max(~plain).alias("large")
    )
    grams = stored(with_grams(docs, members, words), "grams")
    single = grams.select("doc_id", "id_row", "grams", F.explode("middles").alias("middle"))
    edges = product(single.withColumns({"i": zero, "j": zero}), percent)
    large = sized.where(~plain).select("middle", "id_row", "doc_id")
    if large.isEmpty():
        return edges
    grams = stored(grams.where("large").select("doc_id", "id_row", "n", "grams").distinct(), "large")
    centre = grams.select(F.col("id_row").alias("middle"), F.col("doc_id").alias("c"), F.col("n").alias("c_n"), F.col("grams").alias("middle_grams"))
    near = overlap_with_middle(large.join(grams, ["id_row", "doc_id"]).join(centre, "middle").select("middle", "c", "c_n", "id_row", "doc_id", "n", "grams", "middle_grams"))
    union = F.col("n") + F.col("c_n") - F.col("overlap")
    core = 100 * F.col("overlap") >= percent * union
    ring = 100 * (union - F.col("overlap")) <= 2 * (100 - percent) * union  # distance to the middle at most twice the limit
    near = stored(near.select("middle", "c", "doc_id", "id_row", F.when(core, "core").when(ring, "ring").otherwise("far").alias("role")), "roles")
    star = near.where("role = 'core'").select(F.col("c").alias("a"), F.col("doc_id").alias("b"))
    count = lambda *roles: F.ceil(F.count(F.when(F.col("role").isin(*roles), 1)) / (GROUP // 2))
    shape = near.groupBy("middle").agg(count("core").alias("cores"), count("ring").alias("rings"), count("ring", "far").alias("others"))
    near = near.join(shape, "middle")
    piece = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(n), F.lit(1)))
    row_of = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    every = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)).otherwise(F.array().cast("array<struct<i:long,j:long>>"))
    with_others = every("others", lambda j: row_of(F.least(piece("others"), j), F.greatest(piece("others"), j)))
    ring_with_cores = every("cores", lambda j: row_of(-1 - j, piece("rings")))
    core_with_rings = every("rings", lambda i: row_of(-1 - piece("cores"), i))
    where = F.when(F.col("role") == "core", core_with_rings).when(F.col("role") == "ring", F.concat(with_others, ring_with_cores)).otherwise(with_others)
    dealt = near.select("middle", "id_row", "doc_id", F.explode(where).alias("_t")).select("middle", "id_row", "doc_id", "_t.i", "_t.j")
    rest = dealt.join(grams.select("id_row", "doc_id", "grams"), ["id_row", "doc_id"])
    return edges.unionByName(star).unionByName(product(rest, percent))


def similarity_classes(docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`: links reach `percent`."""
    spark, mark = docs.sparkSession, written_so_far()
    rows = stored(incidence(docs, whole_text(text), key, words, percent), "incidence")
    some = rows.where("row is not null")
    classes = some.groupBy("row").agg(
        F.min("doc_id").alias("first"), F.max("id_row").alias("id_row"), F.max("n_shingles").alias("n"), F.max("counts").alias("counts")
    )
    classes = stored(classes, "classes")
    digests = stored(rows.select("doc_id", "n_shingles", "row"), "rows")
    # Rows without an id meet nobody: an equal row with one has the same keys, and a middle needs an id.
    met = [stored(meeting_rows(some.where("doc_id is not null"), turn), "meeting") for turn in range(PASSES)]
    forget_since(spark, mark, classes, digests, *met)
    groups = middles(reduce(DataFrame.unionByName, met))
    forget_since(spark, mark, classes, digests, groups)
    groups = sift(groups, classes.select("id_row", "n", "counts"), percent)
    forget_since(spark, mark, classes, digests, groups)
    groups = groups.join(classes.select("id_row", F.col("first").alias("doc_id")), "id_row")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    parts = stored(components(group_edges(groups, texts, words, percent)), "parts")
    named = classes.join(parts, classes["first"] == parts["node"], "left")
    named = stored(named.select("row", F.coalesce("component", "first").alias("component_id")), "named")
    forget_since(spark, mark, named, digests)
    return digests.select("doc_id", "n_shingles", "row").join(named, "row", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
