"""Helpers that the corpus operators share: tables, stored intermediates, column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or where that is
    unset, as in tests, a folder inside the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"


#: Folders that `stored` wrote, in order.
_written: list[str] = []


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    It cuts the lineage, outlives lost executors, and unlike a checkpoint lets later
    readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    # What was shuffled before is needed no more; Spark's cleaner drops the files of shuffles
    # once their plans are collected. Right after a write its own plan is still held.
    spark.sparkContext._jvm.System.gc()
    writer.parquet(path)
    _written.append(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {name.rsplit("/", 1)[0] for df in frames for name in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def written_so_far() -> int:
    """A mark for `forget_since`."""
    return len(_written)


def forget_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete what was stored after `mark`, but for what the frames `kept` read."""
    needed = {name.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in kept for name in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stay = [path for path in _written[mark:] if path.rsplit("/", 1)[1] in needed]
    for path in set(_written[mark:]) - set(stay):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _written[mark:] = stay


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without the columns of these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def whole_text(column: str = "text"):
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def add_columns(
    df: DataFrame,
    inputs: list,
    fields: list[StructField],
    work: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append `fields`, computed batch by batch from the expressions `inputs`.

    `work` is called once per task and returns the function from input arrays to output
    arrays. Columns of `df` with a new field's name are replaced; `keep` names the
    columns to carry along (all by default).
    """
    names = [f.name for f in fields]
    base = without(df, names) if keep is None else df.select(*keep)
    width, n_inputs = len(base.columns), len(inputs)
    sent = df.select(*[df[f"`{c}`"] for c in base.columns], *[e.alias(f"__in{i}") for i, e in enumerate(inputs)])
    schema = StructType(list(base.schema.fields) + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        compute = work()
        for batch in batches:
            for part in by_bytes(batch):
                made = compute([part.column(width + i) for i in range(n_inputs)])
                columns = [part.column(i).cast(target.field(i).type) for i in range(width)] + [
                    a.cast(target.field(width + i).type) for i, a in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return sent.mapInArrow(run, schema)


def by_bytes(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes, so that memory follows bytes, not rows."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * most / max(1, batch.nbytes))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)
