"""Top division of each country from a dated rating table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.columns import existing_or_null, quoted
from duelframe.functions.dates import lenient_number, lenient_timestamp
from duelframe.operators.checks import require_columns, require_rows


def _counts_column(top_counts: dict[str, int]) -> Column:
    entries = [F.lit(x) for pair in sorted(top_counts.items()) for x in pair]
    listed = F.try_element_at(F.create_map(*entries), F.col("country")) if entries else F.lit(None)
    return F.coalesce(listed, F.lit(K.DEFAULT_TOP_COUNT))


def top_per_country(table: DataFrame, countries: list[str], top_counts: dict[str, int] | None = None) -> DataFrame:
    """The first N teams of each country, N by country.

    A country with any rank is ordered by rank, then rating; one with any rating by
    rating; else by name. The name settles ties. Rows beyond the largest N are cut in
    each task before the shuffle.
    """
    require_columns(table, ["team", "country"], "top teams")
    counts = dict(K.TOP_COUNTS if top_counts is None else top_counts)
    countries = sorted(set(countries))
    rows = table.filter(F.col("country").isin(countries)).withColumns(
        {
            "_rank": lenient_number(existing_or_null(table, "rank")),
            "_elo": lenient_number(existing_or_null(table, "elo")),
        }
    )
    # One row per listed country: as short as the caller's list, so safe to broadcast.
    has = rows.groupBy("country").agg(
        F.max(F.col("_rank").isNotNull()).alias("_any_rank"), F.max(F.col("_elo").isNotNull()).alias("_any_elo")
    )
    ordered = rows.join(F.broadcast(has), "country")
    within = Window.partitionBy("country").orderBy(
        F.when(F.col("_any_rank"), F.col("_rank")).asc_nulls_last(),
        F.when(F.col("_any_rank") | F.col("_any_elo"), F.col("_elo")).desc_nulls_last(),
        F.col("team").asc(),
    )
    largest = max([K.DEFAULT_TOP_COUNT, *counts.values()])
    picked = ordered.withColumn("_place", F.row_number().over(within)).filter(
        (F.col("_place") <= largest) & (F.col("_place") <= _counts_column(counts))
    )
    values = {"rank": F.col("_rank"), "elo": F.col("_elo")}
    return picked.select(*[values[c].alias(c) if c in values else quoted(c) for c in table.columns])


def top_division(table: DataFrame, countries: list[str], top_counts: dict[str, int] | None = None) -> DataFrame:
    """Rows of level 1 if any row of the countries has a level, else the first N teams.

    Which of the two holds is a subquery in the plan; no job runs here.
    """
    require_columns(table, ["team", "country"], "top division")
    fallback = top_per_country(table, countries, top_counts)
    if "level" not in table.columns:
        return fallback
    base = table.filter(F.col("country").isin(sorted(set(countries))))
    any_level = base.agg(F.coalesce(F.max(F.col("level").isNotNull()), F.lit(False))).scalar()
    by_level = base.filter(F.col("level") == 1).filter(any_level)
    numeric = {
        "rank": lenient_number(existing_or_null(table, "rank")),
        "elo": lenient_number(existing_or_null(table, "elo")),
    }
    by_level = by_level.select(*[numeric[c].alias(c) if c in numeric else quoted(c) for c in table.columns])
    return by_level.unionByName(fallback.filter(~any_level))


def asof_snapshot(selection: DataFrame, as_of: str) -> DataFrame:
    """Lean snapshot of the selected teams, stamped with its date."""
    renames = {"team": "team_clubelo"}
    columns = []
    for name in ("team", "country", "rank", "elo", "valid_from", "valid_to"):
        if name not in selection.columns:
            continue
        value = quoted(name)
        if name in ("rank", "elo"):
            value = lenient_number(value)
        elif name in ("valid_from", "valid_to"):
            value = lenient_timestamp(value).cast("timestamp_ntz")
        columns.append(value.alias(renames.get(name, name)))
    return selection.select(*columns, F.lit(as_of).alias("as_of_date"))


def roster(asof: DataFrame) -> DataFrame:
    """Team list of a snapshot with its group label."""
    return asof.select("country", "team_clubelo", F.concat("country", F.lit("-Top")).alias("group_label"))


def checked_top_division(table: DataFrame, countries: list[str], top_counts: dict[str, int] | None = None) -> DataFrame:
    """`top_division` that fails for no rows of the countries or an empty selection."""
    require_columns(table, ["team", "country"], "top division")
    require_rows(
        table.filter(F.col("country").isin(sorted(set(countries)))),
        f"no rows for the countries {sorted(set(countries))}",
    )
    return require_rows(top_division(table, countries, top_counts), "the selection of top teams is empty")
