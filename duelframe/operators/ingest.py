"""Union of landed tables and removal of repeated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.columns import not_null_count, quoted
from duelframe.operators.checks import require_columns


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column one input lacks is null there."""
    if not frames:
        raise ValueError("nothing to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def richest_rows(df: DataFrame, keys: list[str], prefer: list[Column] | None = None) -> DataFrame:
    """Per key the row with most filled columns.

    `prefer` breaks ties (larger first), then the row's own values do, so reruns agree.
    Written as a maximum, not a ranking: each task keeps one row per key before the
    shuffle, so a key that holds much of the table costs no more than others.
    """
    require_columns(df, keys, "deduplication")
    others = [c for c in df.columns if c not in keys]
    ranked = F.struct(
        not_null_count(df).alias("filled"),
        *[p.alias(f"prefer{i}") for i, p in enumerate(prefer or [])],
        *[quoted(c).alias(f"v{i}") for i, c in enumerate(others)],
    )
    best = df.groupBy(*[quoted(k) for k in keys]).agg(F.max(ranked).alias("best"))
    values = {c: F.col(f"best.v{i}") for i, c in enumerate(others)}
    return best.select(*[values[c].alias(c) if c in values else quoted(c) for c in df.columns])
