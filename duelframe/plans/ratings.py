"""Rating tables from landed snapshots and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.operators.history import build_history, selected_histories, team_universe
from duelframe.operators.ingest import union_all
from duelframe.operators.normalize import in_list
from duelframe.operators.snapshot import asof_snapshot, checked_top_division, roster


def rating_universe(snapshots: list[DataFrame], countries=tuple(K.RATING_COUNTRIES)) -> DataFrame:
    """Teams of the wanted countries over all dated snapshots (column `snapshot_date`)."""
    everything = union_all(snapshots)
    if "country" in everything.columns:
        everything = in_list(everything, "country", countries)
    return team_universe(everything)


def rating_history(histories: list[DataFrame], universe: DataFrame, as_of: str) -> DataFrame:
    """All team histories as intervals that reach into the observed years."""
    return build_history(union_all(histories), F.lit(as_of).cast("timestamp_ntz"), universe=universe)


def current_ratings(
    table: DataFrame,
    as_of: str,
    countries=tuple(sorted(K.TOP_COUNTS)),
    top_counts: dict[str, int] | None = None,
    histories: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Snapshot of the top divisions, their roster and, if given, their histories."""
    counts = {**K.TOP_COUNTS, **(top_counts or {})}
    asof = asof_snapshot(checked_top_division(table, list(countries), counts), as_of)
    out = {"asof": asof, "roster": roster(asof)}
    if histories is not None:
        out["histories"] = selected_histories(histories, asof)
    return out
