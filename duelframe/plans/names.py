"""Name maps of the three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.mapping import distinct_names
from duelframe.operators.resolve import (
    DIRECT_PAIR,
    FIRST_SOURCE,
    RATING_SOURCE,
    SECOND_SOURCE,
    as_name_map,
    resolve_names,
)


def _raw(names: DataFrame) -> DataFrame:
    return names.select(F.col("name").alias("raw"))


def map_match_names(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names of the match source: override, else the name itself. Give the raw matches,
    not a table whose names were mapped before."""
    none = distinct_names(matches).filter(F.lit(False))
    return resolve_names(_raw(distinct_names(matches)), none, overrides, FIRST_SOURCE)


def canonical_names(match_map: DataFrame) -> DataFrame:
    """The canonical names a match-source map leads to."""
    return match_map.select(F.col("canonical").alias("name")).distinct()


def map_odds_names(match_history: DataFrame, match_map: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names of the odds source onto the canonical ones."""
    return resolve_names(
        _raw(distinct_names(match_history)), canonical_names(match_map), overrides, SECOND_SOURCE
    )


def map_rating_names(universe: DataFrame, match_map: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names of the rating source onto the canonical ones; see `method` for those left."""
    return resolve_names(
        universe.select(F.col("team").alias("raw")), canonical_names(match_map), overrides, RATING_SOURCE
    )


def map_source_pair(names: DataFrame, targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names of one source directly onto those of another; null if nothing is close."""
    return resolve_names(_raw(names), targets, overrides, DIRECT_PAIR)


__all__ = [
    "as_name_map",
    "canonical_names",
    "map_match_names",
    "map_odds_names",
    "map_rating_names",
    "map_source_pair",
]
