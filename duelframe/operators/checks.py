"""Guards and counters shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from duelframe.functions.columns import quoted


def require_columns(df: DataFrame, needed: list[str], purpose: str) -> None:
    """Fail before any job starts if a column is missing."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns for {purpose}: {missing}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail if there is no row at all (reads one row, not the table)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def guard_rows(df: DataFrame, message: str) -> DataFrame:
    """`df`; a job that reads it fails with `message` if there is no row at all.

    The guard is part of the plan: one more row, dropped after its check, asks a subquery that
    stops at the first row. No job starts before the action.
    """
    found = df.limit(1).agg(F.count(F.lit(1))).scalar()
    never = F.when(found == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False))
    nothing = df.sparkSession.range(1).filter(never)
    return df.unionByName(nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def file_positions(df: DataFrame) -> DataFrame:
    """Rows read from text-like files, with `position`: their place from 0 over all files, in
    order of file name and then of the rows in it.

    Each stretch of a file that one task read is numbered there; the counts of the stretches
    before it, one row a stretch, are added up.
    """
    marked = df.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    stretches = marked.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.orderBy("_file", "_start")
    offsets = stretches.select("_file", "_start", "_first", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    placed = marked.join(offsets, ["_file", "_start"])
    return placed.select(*[quoted(c) for c in df.columns], (F.col("_before") + F.col("_row") - F.col("_first")).alias("position"))


def require_unique(df: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Fail if a non-null key occurs twice: such a table would multiply rows in a join.

    Counts are combined before the shuffle, so one very frequent key is no hot spot.
    """
    known = F.lit(True)
    for key in keys:
        known = known & quoted(key).isNotNull()
    repeated = df.filter(known).groupBy(*[quoted(k) for k in keys]).count().filter("count > 1")
    sample = repeated.limit(5).collect()
    if sample:
        raise ValueError(f"{purpose}: key {keys} is not unique, e.g. {[tuple(r) for r in sample]}")
    return df


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Attach counters that fill in while the next action runs; no extra pass."""
    observation = Observation(name)
    return df.observe(observation, *[c.alias(k) for k, c in metrics.items()]), observation


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: null count per column as `missing_<column>`, and `rows`."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(quoted(c).isNull()).alias(f"missing_{c}") for c in columns],
    )
