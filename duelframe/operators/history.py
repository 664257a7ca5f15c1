"""Rating histories: universe, intervals, cut-off, country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.columns import quoted
from duelframe.functions.dates import lenient_number, lenient_timestamp
from duelframe.operators.checks import require_columns
from duelframe.operators.normalize import rename_existing
from duelframe.operators.sequences import previous_name, with_previous


def team_universe(snapshots: DataFrame) -> DataFrame:
    """Each team once, with the country of its earliest snapshot."""
    require_columns(snapshots, ["team", "snapshot_date"], "team universe")
    if "country" not in snapshots.columns:
        return snapshots.select("team").distinct()
    # The first row's country even if that is null, hence the struct around it.
    first = F.min_by(F.struct("country"), F.struct("snapshot_date", "country"))
    return snapshots.groupBy("team").agg(first.alias("_first")).select("team", "_first.country")


def repair_interval_columns(history: DataFrame) -> DataFrame:
    """`from`/`to` become `valid_from`/`valid_to`; a lone end is the date of the update,
    that is, where the interval starts."""
    history = rename_existing(history, {"from": "valid_from", "to": "valid_to"})
    if "valid_to" in history.columns and "valid_from" not in history.columns:
        return history.withColumnRenamed("valid_to", "valid_from")
    return history


def clean_history(history: DataFrame) -> DataFrame:
    """Dates and ratings parsed leniently: what cannot be read is null."""
    out = repair_interval_columns(history)
    changes = {}
    for name in ("valid_from", "valid_to"):
        if name in out.columns:
            changes[name] = lenient_timestamp(quoted(name)).cast("timestamp_ntz")
    if "elo" in out.columns:
        changes["elo"] = lenient_number(quoted("elo"))
    return out.withColumns(changes) if changes else out


def with_interval_end(
    updates: DataFrame,
    as_of: Column,
    by: str = "team",
    start: str = "valid_from",
    end: str = "valid_to",
    pieces: int | None = None,
) -> DataFrame:
    """An update holds until the day before the team's next one, the last until `as_of`.

    The next row is the previous one in descending order, so a team with a very long
    history can be cut into `pieces` like any other long sequence.
    """
    tie = [(c, "desc_nulls_first") for c in updates.columns if c not in (by, start)]
    following = with_previous(
        updates, [by], [(start, "desc_nulls_first")] + tie, [start], 1, pieces
    )
    name = previous_name(1, start)
    day = F.expr("INTERVAL 1 DAY")
    return following.withColumn(end, F.coalesce(F.col(name) - day, as_of)).drop(name)


def since(history: DataFrame, cutoff: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Intervals that start or end at the cut-off or later."""
    return history.filter((quoted(start) >= cutoff) | (quoted(end) >= cutoff))


def with_country(history: DataFrame, universe: DataFrame) -> DataFrame:
    """Fill the country from the team universe (one row per team)."""
    known = universe.select("team", F.col("country").alias("_country"))
    out = history.join(known, "team", "left")
    if "country" not in history.columns:
        return out.withColumnRenamed("_country", "country")
    return out.withColumn("country", F.coalesce("country", "_country")).drop("_country")


def build_history(
    raw: DataFrame, as_of: Column, cutoff: Column | None = None, universe: DataFrame | None = None
) -> DataFrame:
    """Raw team histories to `team, country, valid_from, valid_to, elo`."""
    out = clean_history(raw)
    if universe is not None and "country" in universe.columns:
        out = with_country(out, universe)
    if "valid_to" not in out.columns:
        out = with_interval_end(out, as_of)
    out = since(out, F.lit(K.SNAPSHOT_START).cast("timestamp_ntz") if cutoff is None else cutoff)
    return out.select(*[c for c in ("team", "country", "valid_from", "valid_to", "elo") if c in out.columns])


def selected_histories(history: DataFrame, asof: DataFrame) -> DataFrame:
    """Histories of the teams in the snapshot, with the snapshot's country."""
    teams = asof.groupBy(F.col("team_clubelo")).agg(F.min("country").alias("country"))
    return history.select(F.col("team").alias("team_clubelo"), "valid_from", "valid_to", "elo").join(
        teams, "team_clubelo", "inner"
    ).select("team_clubelo", "country", "valid_from", "valid_to", "elo")
