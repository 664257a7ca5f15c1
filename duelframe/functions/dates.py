"""Timestamps, seasons and snapshot dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import constants as K


def parse_timestamp(text: Column) -> Column:
    """First format that fits; null if none does."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text),
    )


def lenient_timestamp(value: Column) -> Column:
    """Timestamp, or null if the value is not one."""
    return F.try_to_timestamp(value.cast("string"))


def lenient_number(value: Column) -> Column:
    """Double, or null if the value is not one."""
    return value.try_cast("double")


def strict_timestamp(value: Column) -> Column:
    """Timestamp; a bad value fails the job (ANSI mode)."""
    return F.to_timestamp(value)


def day_before(date: Column) -> Column:
    """Midnight of the previous day, as a plain (zoneless) timestamp."""
    return F.date_sub(date.cast("date"), 1).cast("timestamp_ntz")


def season_start_year(date: Column) -> Column:
    """From July on a date belongs to the season that starts in its own year."""
    return F.when(F.month(date) > 6, F.year(date)).otherwise(F.year(date) - 1)


def season_label(start_year: Column, separator: str = "/") -> Column:
    """`2024/2025`; with another separator also the folder form `2024-2025`."""
    return F.concat_ws(separator, start_year.cast("string"), (start_year + 1).cast("string"))


def short_season_label(start_year: Column) -> Column:
    """`24-25`."""
    two_digits = lambda year: F.lpad((year % 100).cast("string"), 2, "0")
    return F.concat_ws("-", two_digits(start_year), two_digits(start_year + 1))


def compact_season(label: Column) -> Column:
    """`14-15` to `1415`; only the first dash goes."""
    return F.regexp_replace(label, "^([^-]*)-", "$1")


def season_list(spark: SparkSession, as_of: str, first_year: int = K.FIRST_SEASON_YEAR) -> DataFrame:
    """One row per season up to the one `as_of` falls in, with its three labels."""
    end = season_start_year(F.to_date(F.lit(as_of)))
    return (
        spark.range(1)
        .filter(end >= first_year)  # a sequence would count down
        .select(F.explode(F.sequence(F.lit(first_year), end)).alias("start_year"))
        .select(
            "start_year",
            season_label(F.col("start_year")).alias("season"),
            season_label(F.col("start_year"), "-").alias("folder"),
            short_season_label(F.col("start_year")).alias("short"),
        )
    )


def snapshot_dates(start: Column, end: Column, step_days: int = K.SNAPSHOT_STEP_DAYS) -> Column:
    """Array of snapshot days: every `step_days` from `start` while not after `end`."""
    step = F.expr(f"INTERVAL {int(step_days)} DAYS")
    first, last = start.cast("date"), end.cast("date")
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<date>"))
