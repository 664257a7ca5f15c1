"""Removal of long repeated byte strings through a logarithmic family of suffix arrays.

Sparse suffixes. Every string of `LENGTH` bytes holds an anchor: a place whose hash is
least among the places at which a seed of `SEED` bytes still fits into the string. Equal
strings have their anchors at equal places, so suffixes are kept for anchors only. They
are compared by names (64-bit hashes) of growing stretches, as in prefix doubling: first
the seed, then the whole stretch that any string around the anchor can reach.

Index family. Suffixes of a new batch are sorted into an array of their own. A merge scan
streams two sorted arrays as one and keeps the suffixes whose seed stands there twice;
arrays of equal rank are merged into one of the next rank, so that a suffix is sorted anew
only as often as the number of batches doubles. Sorting is by range over all columns,
which splits a seed of any frequency over tasks.

Exact ends. A string around an anchor starts 0 to `LENGTH - SEED` bytes before it. If the
longest stretch has a twin, all these strings repeat; if not, the range of starts is split
and each part is compared by the names of what all its strings share (no twin: none
repeats) and of what they cover together (a twin: all repeat), down to single strings.
Of stretches that have a twin only one stays as a partner for others.

Bytes of a text are its UTF-8 bytes; null is empty. Equal texts are one text with copies:
from `LENGTH` bytes on they go wholly. Texts below `LENGTH` bytes are never touched. What
is removed is judged on the input, all occurrences alike, overlapping ones in one text too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField

from duelframe.llm.common import add_columns, forget, forget_since, stored, whole_text, written_so_far

LENGTH, SEED = 400, 128
#: Anchors of one seed that are judged in one task; more are judged by rounds of names.
LOCAL = 1_024
#: Rows a task judges together, and group size from which it sorts instead of comparing.
TOGETHER, SORTED = 2_048, 24
#: Batches that one table is indexed in, and parts of a range of starts per round.
BATCHES, PARTS = 2, 8
SUFFIX = ["seed", "reach", "rid", "pos"]


def text_key(text: Column) -> Column:
    """128-bit digest of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width] for each i that has so many, by doubling."""
    have, row = 1, values
    while have * 2 <= width:
        row = pick(row[:-have], row[have:])
        have *= 2
    rest = width - have
    return pick(row[: len(row) - rest], row[rest:]) if rest else row


def anchors(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> list[np.ndarray]:
    """The anchors of each text: least hashes of 8 bytes, among the length - seed + 1 places
    of each string of `length` bytes; equal hashes all count."""
    if not texts:
        return []
    width = length - seed + 1
    raw = b"".join(texts)
    n = len(raw)
    padded = raw + bytes(16)
    grams = np.empty(-(-n // 8) * 8, np.uint64)
    for k in range(8):
        grams[k::8] = np.frombuffer(padded, "<u8", len(grams) // 8, k) if len(padded) >= k + len(grams) else 0
    order = ((grams * np.uint64(0x9E3779B97F4A7C15)) ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = (order >> np.uint64(32)).astype(np.uint32)[:n] | np.uint32(1)
    if n < width:
        return [np.zeros(0, np.int64) for _ in texts]
    least = np.zeros(n + width, np.uint32)  # of the string starting at s, at s + width - 1; 0: no string
    found = slide(order, width, np.minimum)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        last = e - length + 1
        if last > b:
            least[b + width - 1 : last + width - 1] = found[b:last]
    top = slide(least, width, np.maximum)[:n]
    places = np.flatnonzero(top == order)
    cuts = np.searchsorted(places, ends)
    return [places[a:b] - s for a, b, s in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), begins.tolist(), strict=True)]


def name(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece)


def suffixes(docs: DataFrame, text: Column, length: int, seed: int) -> DataFrame:
    """(key, n_bytes, rid, pos, seed, reach) of each text of `length` bytes or more: arrays
    of the anchors' places and of their names; `reach` is 0 where the stretch that all
    strings around an anchor cover would leave the text."""
    rows = docs.select(text.cast("binary").alias("body")).where(F.octet_length("body") >= length)
    rows = rows.withColumn("key", F.unhex(F.md5("body"))).withColumn("n_bytes", F.octet_length("body").cast("long"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    left = length - seed

    def work():
        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            bodies = columns[0].to_pylist()
            places, seeds, reaches = anchors(bodies, length, seed), [], []
            for body, own in zip(bodies, places, strict=True):
                own = own.tolist()
                end = len(body)
                seeds.append(np.array([name(body[p : p + seed]) for p in own], np.uint64).view(np.int64))
                reach = [name(body[p - left : p + length]) | 1 if p >= left and p + length <= end else 0 for p in own]
                reaches.append(np.array(reach, np.uint64).view(np.int64))
            longs = pa.list_(pa.int64())
            return [pa.array(places, pa.list_(pa.int32())), pa.array(seeds, longs), pa.array(reaches, longs)]

        return compute

    fields = [
        StructField("pos", ArrayType(IntegerType())),
        StructField("seed", ArrayType(LongType())),
        StructField("reach", ArrayType(LongType())),
    ]
    return add_columns(rows, [F.col("body")], fields, work, ["key", "n_bytes", "rid"])


def sorted_array(rows: DataFrame) -> DataFrame:
    """Suffixes in order, dealt by range."""
    return rows.select(*SUFFIX).repartitionByRange(*SUFFIX).sortWithinPartitions(*SUFFIX)


def twin_seeds(array: DataFrame) -> DataFrame:
    """The suffixes of a sorted array whose seed stands there twice. Each task streams its
    part; the first and last seed of a part may go on in another, so they are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, many = None, True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            seed = rows.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
            sizes = np.diff(np.append(starts, len(seed)))
            keep = np.repeat(sizes > 1, sizes)
            if first or many:
                keep[: sizes[0]] = True
            if len(starts) > 1:
                done = int(starts[-1])
                first, many = False, False
            else:
                done = len(seed) - 1
                many = many or done > 0
            if keep[:done].any():
                yield rows.slice(0, done).filter(pa.array(keep[:done]))
            held = rows.slice(done)
        if held is not None and held.num_rows:
            yield held

    return array.mapInArrow(run, array.schema)


class IndexFamily:
    """Suffix arrays by rank; an array of rank r holds 2 ** r batches."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        #: Twins inside each level, and those between a batch and a level it was not merged with.
        self.inside: dict[int, DataFrame] = {}
        self.across: list[DataFrame] = []

    def add(self, batch: DataFrame, last: bool = False, source: DataFrame | None = None) -> None:
        """Index a batch of suffixes and note those whose seed is there twice. After the `last`
        one nothing is merged any more: the scan reads the merged array as it is sorted, no copy
        is kept. The stored `source` of the batch goes as soon as the batch is an array."""
        spark = batch.sparkSession
        array = stored(sorted_array(batch), "suffixes")
        if source is not None:
            forget(spark, source)
        rank, chain = 0, []
        while rank in self.levels:
            chain.append(self.levels.pop(rank))
            rank += 1
        for level in self.levels.values():  # of other ranks: scanned, not merged
            self.across.append(stored(twin_seeds(sorted_array(array.unionByName(level))), "twins"))
        # What the merged arrays held of twins, the scan of the new one finds again.
        forget(spark, *[self.inside.pop(r) for r in range(rank)])
        for k, level in enumerate(chain):
            merged = sorted_array(array.unionByName(level))
            if last and k == len(chain) - 1:
                self.inside[rank] = stored(twin_seeds(merged), "twins")
                forget(spark, array, level)
                return
            merged = stored(merged, "suffixes")
            forget(spark, array, level)
            array = merged
        self.inside[rank] = stored(twin_seeds(array), "twins")
        self.levels[rank] = array

    def twins(self) -> DataFrame:
        """Suffixes whose seed stands somewhere else too, as far as parts of one task tell:
        the ends of a task's part are among them without proof."""
        first, *rest = [*self.inside.values(), *self.across]
        out = first
        for more in rest:
            out = out.unionByName(more)
        return out.distinct() if rest else out


def split(low: Column, high: Column, parts: int) -> Column:
    """The range of starts low to high in up to `parts` equal ranges."""
    step = F.ceil((high - low + 1) / parts).cast("int")
    return F.transform(
        F.sequence(low, high, step),
        lambda a: F.struct(a.alias("low"), F.least(a + step - 1, high).alias("high")),
    )


class Judge:
    """Finds the strings around anchors that stand around another anchor of the seed too."""

    def __init__(self, length: int, seed: int):
        self.length, self.left = length, length - seed
        self.wide = self.left + length
        random = np.random.default_rng(2)
        self.letters = random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0xD1342543DE82EF95
        self.up = np.array([pow(base, i, 1 << 64) for i in range(self.wide)], np.uint64)
        self.down = np.array([pow(base, -i, 1 << 64) for i in range(self.left + 1)], np.uint64)

    def repeated(self, seeds: np.ndarray, lefts: np.ndarray, bodies: list[bytes]) -> np.ndarray:
        """[row, c]: whether the string starting left - c bytes before the anchor repeats.
        Rows are in seed order."""
        n = len(seeds)
        sizes = np.fromiter(map(len, bodies), np.int64, n)
        rows = np.zeros(n * self.wide, np.uint8)
        first = self.left - lefts
        begins = np.cumsum(sizes) - sizes
        rows[np.arange(int(sizes.sum())) + np.repeat(np.arange(n) * self.wide + first - begins, sizes)] = np.frombuffer(b"".join(bodies), np.uint8)
        sums = np.zeros((n, self.wide + 1), np.uint64)
        np.cumsum(self.letters[rows.reshape(n, -1)] * self.up, axis=1, out=sums[:, 1:])
        names = (sums[:, self.length :] - sums[:, : self.left + 1]) * self.down
        at = np.arange(self.left + 1)
        valid = (at >= first[:, None]) & (at + self.length <= (first + sizes)[:, None])
        out = np.zeros(valid.shape, bool)
        starts = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1]))
        group = np.diff(np.append(starts, n))
        own = np.repeat(group, group)
        for k in range(1, min(int(group.max()), SORTED)):
            i = np.flatnonzero((seeds[:-k] == seeds[k:]) & (own[k:] < SORTED))
            same = (names[i] == names[i + k]) & valid[i] & valid[i + k]
            out[i] |= same
            out[i + k] |= same
        for start, size in zip(starts[group >= SORTED].tolist(), group[group >= SORTED].tolist(), strict=True):
            part, good = names[start : start + size], valid[start : start + size]
            order = np.lexsort((part, ~good), axis=0)
            part, good = np.take_along_axis(part, order, 0), np.take_along_axis(good, order, 0)
            same = (part[1:] == part[:-1]) & good[1:] & good[:-1]
            twin = np.zeros(part.shape, bool)
            twin[1:] |= same
            twin[:-1] |= same
            np.put_along_axis(out[start : start + size], order, twin, 0)
        return out

    def ranges(self, seeds, lefts, bodies, open_) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, low, high) of the open rows."""
        rep = self.repeated(seeds, lefts, bodies) & open_[:, None]
        edge = np.diff(np.pad(rep, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        return row, self.left - end + 1, self.left - begin


def judge_together(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """As `refine`, for seeds of no more than `LOCAL` anchors: all of a seed in one task."""
    columns = ["seed", "rid", "pos", "open", "left", "body"]
    dealt = contexts.select(*columns).repartition("seed").sortWithinPartitions("seed", "rid", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(length, seed)

        def judged(rows: pa.RecordBatch) -> pa.RecordBatch:
            row, low, high = judge.ranges(
                rows.column(0).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_pylist(),
                rows.column(3).to_numpy(zero_copy_only=False),
            )
            at = pa.array(row)
            found = [rows.column(1).take(at), rows.column(2).take(at), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
            return pa.RecordBatch.from_arrays(found, names=["rid", "pos", "low", "high"])

        held = None
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(first, TOGETHER)
                rows = rows if held is None else pa.concat_batches([held, rows])
                seeds = rows.column(0).to_numpy()
                done = int(np.searchsorted(seeds, seeds[-1]))  # the last seed may go on
                if done:
                    yield judged(rows.slice(0, done))
                held = rows.slice(done)
        if held is not None and held.num_rows:
            yield judged(held)

    return dealt.mapInArrow(run, "rid long, pos int, low int, high int")


def refine(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """(rid, pos, low, high): ranges of starts before an anchor whose strings all repeat.

    `contexts` holds (rid, pos, seed, open, left, body): the bytes around an anchor from
    `left` bytes before it on, and whether its strings are still to be judged (others are
    partners that have a twin already)."""
    here = contexts.withColumn("ranges", F.array(F.struct(F.lit(0).alias("low"), F.lit(length - seed).alias("high"))))
    here = here.select("rid", "pos", "seed", "open", "left", "body", "ranges")
    out, size = None, length - seed + 1
    at = ["seed", "low", "high"]
    while True:
        parts = here.select("rid", "pos", "seed", "open", "left", "body", F.explode("ranges").alias("_r"))
        if size > 1:
            parts = parts.withColumn("_r", F.explode(split(F.col("_r.low"), F.col("_r.high"), PARTS)))
        size = -(-size // PARTS)
        parts = parts.select("rid", "pos", "seed", "open", "left", "body", "_r.low", "_r.high")
        right = F.octet_length("body") - F.col("left")
        some = (F.greatest("low", F.lit(length) - right) <= F.least("high", "left"))
        every = (F.col("high") <= F.col("left")) & (F.lit(length) - F.col("low") <= right)
        piece = lambda start, stop: F.xxhash64(F.substring("body", F.col("left") - start + 1, start + stop))
        named = parts.where(some).select(
            "rid", "pos", *at, "open",
            piece(F.col("low"), F.lit(length) - F.col("high")).alias("core"),
            F.when(every, piece(F.col("high"), F.lit(length) - F.col("low"))).alias("hull"),
        )
        named = stored(named, "ranges")
        weight = F.when(F.col("open"), 1).otherwise(2)
        cores = named.groupBy(*at, "core").agg(F.sum(weight).alias("_w"), F.max("open").alias("_o"))
        cores = stored(cores.where("_w >= 2 and _o").select(*at, "core"), "cores")
        live = named.join(cores, [*at, "core"], "left_semi")
        hulls = live.where("hull is not null").groupBy(*at, "hull")
        hulls = hulls.agg(F.sum(weight).alias("_w"), F.min(F.struct("rid", "pos")).alias("_one"))
        hulls = stored(hulls.where("_w >= 2").select(*at, "hull", "_one"), "hulls")
        live = stored(live.join(hulls, [*at, "hull"], "left"), "live")
        done = live.where("open and _one is not null").select("rid", "pos", "low", "high")
        out = done if out is None else out.unionByName(done)
        if size == 1 and live.where("high > low").isEmpty():
            return out
        one = F.struct("rid", "pos") == F.col("_one")
        after = live.where(F.col("_one").isNull() | one).where("high > low")
        after = after.withColumn("open", F.col("open") & F.col("_one").isNull())
        grouped = after.groupBy("rid", "pos", "open").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
        here = stored(grouped, "open").join(contexts.drop("open"), ["rid", "pos"])
        here = here.select("rid", "pos", "seed", "open", "left", "body", "ranges")


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, text: Column, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES) -> DataFrame:
    """(key, starts, ends): the spans of bytes that each different text loses; they may
    overlap."""
    spark, mark = docs.sparkSession, written_so_far()
    every = stored(suffixes(docs, text, length, seed), "anchors")
    texts = every.groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("_n"), F.max("n_bytes").alias("n_bytes"))
    texts = stored(texts.select("key", "rid", "n_bytes", (F.col("_n") > 1).alias("whole")), "texts")
    one = every.select("rid", F.explode(F.arrays_zip("seed", "reach", "pos")).alias("_a")).select("rid", "_a.*")
    family = IndexFamily()
    for batch in range(batches):
        last = batch == batches - 1
        family.add(one.where(F.pmod(F.xxhash64("rid"), F.lit(batches)) == batch), last, every if last else None)
    forget_since(spark, mark, texts, *family.inside.values(), *family.across)

    # One copy of each text goes on: the others' suffixes leave by this join.
    twins = stored(family.twins().hint("shuffle_merge").join(texts.select("rid", "whole"), "rid"), "marks")
    forget_since(spark, mark, texts, twins)
    reaches = twins.where("reach <> 0").groupBy("seed", "reach")
    reaches = reaches.agg(F.count("*").alias("_n"), F.min(F.struct("rid", "pos")).alias("_one"), F.max("whole").alias("_w"))
    reaches = stored(reaches.where("_n > 1 or _w").select("seed", "reach", "_one"), "reaches")
    marks = stored(twins.hint("shuffle_merge").join(reaches, ["seed", "reach"], "left"), "judged")
    forget_since(spark, mark, texts, marks)
    full = marks.where("not whole and _one is not null").select("rid", "pos", F.lit(0).alias("low"), F.lit(length - seed).alias("high"))
    open_ = ~F.col("whole") & F.col("_one").isNull()
    partner = F.when(F.col("reach") != 0, F.struct("rid", "pos") == F.col("_one")).otherwise(F.col("whole"))
    wanted = marks.where(open_ | partner).select("rid", "pos", "seed", open_.alias("open"))
    seeds = wanted.groupBy("seed").agg(F.count("*").alias("_n"), F.max("open").alias("_o"))
    seeds = stored(seeds.where("_n > 1 and _o").select("seed", (F.col("_n") > LOCAL).alias("hot")), "seeds")
    wanted = wanted.hint("shuffle_merge").join(seeds, "seed")
    places = wanted.groupBy("rid").agg(F.collect_list(F.struct("pos", "seed", "open", "hot")).alias("places"))
    places = places.unionByName(full.select("rid").distinct().withColumn("places", F.array().cast(places.schema["places"].dataType)))
    places = places.groupBy("rid").agg(F.flatten(F.collect_list("places")).alias("places"))
    bodies = docs.select(text.cast("binary").alias("body")).where(F.octet_length("body") >= length)
    bodies = bodies.withColumn("key", F.unhex(F.md5("body"))).hint("shuffle_merge")
    marked = bodies.join(places.join(texts, "rid").select("key", "rid", "whole", "places"), "key")
    marked = stored(marked.withColumn("copy", F.monotonically_increasing_id()), "marked")
    hot_seeds = not seeds.where("hot").isEmpty()
    full = stored(full, "full")
    forget_since(spark, mark, texts, marked, full)
    # A text that is not whole has one copy. Of the others' copies one serves as partner.
    first = marked.where("whole").groupBy("rid").agg(F.min("copy").alias("copy"))
    partners = marked.where("whole").join(stored(first, "first"), ["rid", "copy"], "left_semi")

    around = marked.where("not whole").unionByName(partners)
    around = around.select("rid", "body", F.explode("places").alias("_p")).select("rid", "body", "_p.*")
    left = F.least(F.col("pos"), F.lit(length - seed))
    context = F.substring("body", F.col("pos") - left + 1, left + length)
    contexts = around.select("rid", "pos", "seed", "open", "hot", left.alias("left"), context.alias("body"))
    ranges = stored(judge_together(contexts.where("not hot"), length, seed), "spans").unionByName(full)
    hot = contexts.where("hot").drop("hot")
    if hot_seeds:
        ranges = ranges.unionByName(refine(stored(hot, "contexts"), length, seed))
    spans = ranges.groupBy("rid").agg(
        F.collect_list((F.col("pos") - F.col("high")).cast("long")).alias("starts"),
        F.collect_list((F.col("pos") - F.col("low") + length).cast("long")).alias("ends"),
    )

    # Of a text that goes wholly every copy is one span; the bodies themselves stay behind.
    gone = texts.where("whole").select("key", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"))
    once = spans.join(texts.where("not whole").select("rid", "key"), "rid").select("key", "starts", "ends")
    cuts = stored(once.unionByName(gone), "cuts")
    forget_since(spark, mark, cuts)
    return cuts


def cut_spans(rows: DataFrame, body: Column, keep: list[str]) -> DataFrame:
    """The columns `keep` of `rows` with what the spans `starts`, `ends` take from `body`:
    n_removed, n_spans, and the `kept` bytes (null where there are no spans: all of them)."""

    def work():
        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            removed, counts, kept = [], [], []
            for own, starts, ends in zip(*(c.to_pylist() for c in columns), strict=True):
                cut = merge_spans(np.array(starts), np.array(ends)) if starts else []
                removed.append(sum(b - a for a, b in cut))
                counts.append(len(cut))
                edges = [0, *(x for span in cut for x in span), len(own or b"")]
                kept.append(b"".join(own[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)) if cut else None)
            return [pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())]

        return compute

    fields = [StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", BinaryType())]
    inputs = [F.when(F.col("starts").isNotNull(), body.cast("binary")), F.col("starts"), F.col("ends")]
    return add_columns(rows, inputs, fields, work, keep)


def judged(docs: DataFrame, length: int = LENGTH, text: str = "text", seed: int = SEED) -> DataFrame:
    """Each row of `docs` as one value `_row`, with what its text loses (see `cut_spans`).
    Texts meet their spans in one shuffle of the rows, by the key of the text."""
    cuts = repeats(docs, whole_text(text), length, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_key(whole_text(text)).alias("key"))
    return cut_spans(rows.hint("shuffle_merge").join(cuts, "key", "left"), whole_text(f"_row.`{text}`"), ["_row"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """`docs` with its repeated bytes cut out of `text`. Bytes that a cut leaves of a broken
    character are dropped, since a string cannot hold them."""
    found = judged(docs, length, seed=seed)
    clean = F.when(F.col("kept").isNull(), F.col("_row.text")).otherwise(valid_text(F.col("kept")))
    return found.select(F.col("_row").withField("text", clean).alias("_row")).select("_row.*")


def valid_text(body: Column) -> Column:
    """Bytes as text, without what is no valid UTF-8."""
    return F.replace(F.make_valid_utf8(body.cast("string")), F.lit("�"), F.lit(""))
