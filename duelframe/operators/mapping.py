"""Name maps `(raw, canonical)` applied to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions.columns import quoted
from duelframe.operators.checks import require_columns


def unique_map(name_map: DataFrame) -> DataFrame:
    """One canonical name per raw name (the smallest if the map repeats one)."""
    require_columns(name_map, ["raw", "canonical"], "name map")
    return name_map.filter(F.col("raw").isNotNull()).groupBy("raw").agg(F.min("canonical").alias("canonical"))


def replace_names(df: DataFrame, name_map: DataFrame, columns: list[str]) -> DataFrame:
    """Replace values through the map; values it does not hold stay."""
    lookup = unique_map(name_map)
    out = df
    for i, name in enumerate(columns):
        side = lookup.select(F.col("raw").alias(f"_raw{i}"), F.col("canonical").alias(f"_name{i}"))
        out = out.join(side, quoted(name) == F.col(f"_raw{i}"), "left")
    replaced = {name: F.coalesce(F.col(f"_name{i}"), quoted(name)) for i, name in enumerate(columns)}
    return out.select(*[replaced[c].alias(c) if c in replaced else quoted(c) for c in df.columns])


def canonical_only(df: DataFrame, name_map: DataFrame, column: str) -> DataFrame:
    """Replace values through the map and drop rows it does not hold."""
    lookup = unique_map(name_map)
    out = df.join(lookup, quoted(column) == F.col("raw"), "inner")
    return out.select(*[F.col("canonical").alias(c) if c == column else quoted(c) for c in df.columns])


def distinct_names(*tables: DataFrame, columns: tuple[str, ...] = ("home_team", "away_team")) -> DataFrame:
    """Every name in any of the columns of any table, once, as column `name`."""
    names = None
    for table in tables:
        found = table.select(F.explode(F.array(*[quoted(c) for c in columns])).alias("name"))
        names = found if names is None else names.union(found)
    return names.filter(F.col("name").isNotNull()).distinct()


def unmatched_names(names: DataFrame, known: DataFrame, column: str = "name") -> DataFrame:
    """Sorted names that `known` (same column) lacks."""
    return names.select(column).distinct().join(known.select(column), column, "left_anti").orderBy(column)
