"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a ring table;
when shards are appended, a row either stays or moves to a new shard. A null key counts
as key 0. Rows with equal keys share a shard; each still gets a slot of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from duelframe.llm.common import add_columns, stored

#: Multiplier of the 64-bit generator that jump consistent hashing draws from; fixed value.
JUMP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard 0 to shards - 1 of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    out = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        out[going] = jump[going]
        state[going] = state[going] * JUMP + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[going] = ((out[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[jump[going] < shards]
    return out


def with_shards(rows: DataFrame, key: str, columns: dict[str, int]) -> DataFrame:
    """`rows` with a column for each number of shards in `columns`, all from one pass over
    the rows: a task keeps one Python worker, however many columns are asked for."""

    def work():
        def compute(inputs: list[pa.Array]) -> list[pa.Array]:
            keys = inputs[0].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            return [pa.array(jump_hash(keys, n), pa.int32()) for n in columns.values()]

        return compute

    fields = [StructField(name, IntegerType()) for name in columns]
    return add_columns(rows, [F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))], fields, work)


def assign(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """`rows` with `shard`, `grown_shard` (with one more shard) and `slot`.

    Slots number a shard's rows from 0 without gaps. Each task's rows are numbered on
    their own, after the counts of the tasks before: no task sees a whole shard. `rows`
    is stored with its shards once, so give only the columns to keep.
    """
    named = with_shards(rows, key, {"shard": shards, "grown_shard": shards + 1})
    base = stored(named.withColumn("_part", F.spark_partition_id()), "shards")
    counts = base.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    offsets = counts.select("shard", "_part", before.alias("_before"))
    order = Window.partitionBy("shard", "_part").orderBy(*[c for c in rows.columns])
    numbered = base.withColumn("_row", F.row_number().over(order) - 1)
    slot = (F.col("_before") + F.col("_row")).cast("long")
    return numbered.join(offsets, ["shard", "_part"]).withColumn("slot", slot).drop("_part", "_row", "_before")
