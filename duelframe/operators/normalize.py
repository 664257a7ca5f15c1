"""Bring raw match tables to one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe import constants as K
from duelframe.functions.columns import known_first, quoted, sql_name
from duelframe.functions.dates import parse_timestamp, strict_timestamp
from duelframe.functions.text import path_key


def rename_existing(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename the columns that exist; refuse to make two columns of one name."""
    renames = {old: new for old, new in aliases.items() if old in df.columns}
    result = [renames.get(c, c) for c in df.columns]
    clashes = sorted({c for c in result if result.count(c) > 1})
    if clashes:
        raise ValueError(f"renaming would repeat columns: {clashes}")
    return df.withColumnsRenamed(renames) if renames else df


def lower_case_columns(df: DataFrame) -> DataFrame:
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("columns differ only in case")
    return df.toDF(*names)


def cast_existing(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the listed columns that exist, in one projection. Bad values fail the job."""
    return df.select(
        *[quoted(c).cast(types[c]).alias(c) if c in types else quoted(c) for c in df.columns]
    )


def with_parsed_date(df: DataFrame, column: str = "date") -> DataFrame:
    """Text is parsed leniently, a date is widened, a timestamp stays."""
    if column not in df.columns:
        return df
    type_ = df.schema[column].dataType
    if isinstance(type_, T.StringType):
        return df.withColumn(column, parse_timestamp(quoted(column)).cast("timestamp_ntz"))
    if isinstance(type_, T.DateType):
        return df.withColumn(column, quoted(column).cast("timestamp_ntz"))
    return df


def normalise_matches(df: DataFrame) -> DataFrame:
    """Known aliases to internal names, dates parsed, target types. No sort: row order
    is the window's business."""
    return cast_existing(with_parsed_date(rename_existing(df, K.COLUMN_ALIASES)), K.MATCH_TYPES)


def normalise_landed(df: DataFrame) -> DataFrame:
    """A landed per-season file: lower-case names, its own aliases, strict dates."""
    out = rename_existing(lower_case_columns(df), K.LANDED_ALIASES)
    if "date" in out.columns:
        out = out.withColumn("date", strict_timestamp(F.col("date")))
    return out


def with_path_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spaces to underscores in the columns a sink is partitioned by."""
    return df.withColumns({c: path_key(F.col(c)) for c in columns})


def base_matches(df: DataFrame) -> DataFrame:
    """The match-level columns the features need, those that exist, in fixed order."""
    return df.select(*[quoted(c) for c in K.BASE_COLUMNS if c in df.columns])


def reorder(df: DataFrame, order: list[str]) -> DataFrame:
    """Known columns first, the others behind them."""
    return df.selectExpr(*[sql_name(c) for c in known_first(df.columns, order)])


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def drop_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def in_list(df: DataFrame, column: str, values) -> DataFrame:
    """Membership in a short list given by the caller; the filter reaches the scan."""
    return df.filter(quoted(column).isin(list(values)))
