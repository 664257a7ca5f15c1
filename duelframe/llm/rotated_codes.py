"""Nearest neighbours by inner product through randomly rotated one-bit codes.

A vector, less the centre, is rotated at random and kept as its sign bits, its length and
the share of its length that the signs carry. Sign bits against a rotated query estimate
the inner product without bias, and the share bounds the error; only vectors whose upper
estimate reaches what the query already has are scored exactly, in double precision.

Every vector is coded; the centre is the mean of a sample of `SAMPLE` vectors. Queries go in blocks of `BLOCK_QUERIES`, each one pass over the codes.
Vectors that are null, zero, of a length other than the most frequent one, or hold null or
non-finite components take no part, nor do rows without an id. Equal scores go by smaller
id; of repeated query ids one is searched (the largest vector), repeated candidates each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import stored

SAMPLE = 4_096
BLOCK_QUERIES = 2_048
#: Vectors estimated at a time in a task.
BLOCK_ROWS = 8_192
#: Queries estimated against them at a time.
BLOCK_TOGETHER = 256
#: Half width of the error bound in standard deviations.
EPSILON = 3.0


@dataclass
class Frame:
    """What coding needs: the centre and the rotation."""

    centre: np.ndarray
    rotation: np.ndarray


def rotation(size: int, seed: int = 4) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths and sign shares (<= 1) of vectors."""
    rest = vectors - frame.centre
    length = np.sqrt((rest**2).sum(axis=1))
    turned = rest @ frame.rotation.T
    share = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / np.maximum(length, 1e-300)
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, share, 1.0)


def estimate(
    queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray, shares: np.ndarray, frame: Frame, epsilon: float = EPSILON
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products [query, vector] and the half widths of their bounds."""
    size = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    turned = (queries @ frame.rotation.T / np.sqrt(size)).astype(np.float32)
    scale = (lengths / shares).astype(np.float32)
    base = (queries @ frame.centre).astype(np.float32)
    norms = np.sqrt((queries**2).sum(axis=1))
    spread = lengths * np.sqrt(np.maximum(1 - shares**2, 0)) / shares / np.sqrt(max(size - 1, 1))
    return base[:, None] + turned @ signs.T * scale, (epsilon * norms[:, None] * spread[None, :]).astype(np.float32)


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def build_index(vectors: DataFrame, key: str, vector: str, sample: int = SAMPLE) -> tuple[DataFrame, Frame]:
    """The stored table (id, v, code, length, share) of all vectors, and its frame."""
    rows = clean(vectors, key, vector)
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()
    values = np.array([r["v"] for r in picked], float) if picked else np.zeros((1, 1))
    frame = Frame(values.mean(axis=0), rotation(values.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, lengths, shares = encode(matrix(batch.column(1)), frame)
                columns = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())]
                columns += [pa.array(lengths), pa.array(shares)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "code", "length", "share"])

    coded = rows.mapInArrow(run, "id long, v array<double>, code binary, length double, share double")
    return stored(coded, "codes"), frame


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, larger scores first, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search(index: DataFrame, frame: Frame, queries: list, k: int) -> DataFrame:
    """(query_id, vec_id, score): for one block of queries, the k best of each task.

    In each block of vectors, the k largest estimates are scored first if the query has not
    k scores yet; then whatever the bounds cannot rule out against the k-th best."""
    asked = np.array([q["id"] for q in queries], np.int64)
    points = np.array([q["v"] for q in queries], float)
    shared = index.sparkSession.sparkContext.broadcast((asked, points, frame))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, points, frame = shared.value
        kept_ids = [np.zeros(0, np.int64) for _ in asked]
        kept = [np.zeros(0) for _ in asked]
        least = np.full(len(asked), -np.inf)

        def rerank(q: int, ids: np.ndarray, vectors: np.ndarray) -> None:
            all_ids, all_scores = np.append(kept_ids[q], ids), np.append(kept[q], vectors @ points[q])
            order = best(all_scores, all_ids, k)
            kept_ids[q], kept[q] = all_ids[order], all_scores[order]
            least[q] = kept[q][-1] if len(order) == k else -np.inf

        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                ids, vectors = part.column(0).to_numpy(), matrix(part.column(1))
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                lengths, shares = part.column(3).to_numpy(), part.column(4).to_numpy()
                for start in range(0, len(asked), BLOCK_TOGETHER):
                    rows = slice(start, start + BLOCK_TOGETHER)
                    guess, width = estimate(points[rows], codes, lengths, shares, frame)
                    guess[asked[rows, None] == ids[None, :]] = -np.inf  # not the query's own row
                    top = guess + width
                    for q in range(len(guess)):
                        first_seen = least[start + q] == -np.inf
                        if first_seen:
                            at = np.argpartition(-guess[q], k)[:k] if len(ids) > k else np.arange(len(ids))
                            at = at[guess[q][at] > -np.inf]
                            rerank(start + q, ids[at], vectors[at])
                            top[q, at] = -np.inf
                        at = np.flatnonzero(top[q] >= least[start + q])
                        at = at[top[q][at] > -np.inf]
                        if len(at):
                            rerank(start + q, ids[at], vectors[at])
        sizes = [len(x) for x in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(asked, sizes)), pa.array(np.concatenate(kept_ids)), pa.array(np.concatenate(kept))],
            names=["query_id", "vec_id", "score"],
        )

    sent = index.select("id", "v", "code", "length", "share")
    return sent.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, key: str, vector: str, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that `is_query` (a
    condition on `id`) picks, among all other rows."""
    index, frame = build_index(vectors, key, vector)
    asked = index.where(is_query).groupBy("id").agg(F.max("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()
        if own:
            part = search(index, frame, own, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        empty = "query_id long, rank int, vec_id long, score double"
        return index.sparkSession.createDataFrame([], empty)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
