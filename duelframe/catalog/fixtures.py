"""Match-shaped views of the test tables: one SQL text for Spark and DuckDB.

Orders play the matches (status `P` has no score yet), line items the rating history,
suppliers the current rating table, parts the names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from duelframe.session import apply_settings

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

_PLAYED = "case when o_orderstatus = 'P' then null else {} end"


def _played(expression: str, alias: str) -> str:
    return _PLAYED.format(expression) + f" as {alias}"


RECIPES: dict[str, tuple[list[str], str]] = {}


def _recipe(name: str, needs: list[str], sql: str) -> None:
    RECIPES[name] = (needs, sql)


_MEASURES = ", ".join(
    [
        _played("cast(floor(o_totalprice) as int) % 5", "home_goals"),
        _played("cast(floor(o_totalprice / 5) as int) % 4", "away_goals"),
        _played("(cast(floor(o_totalprice) as int) % 300) / 100e0", "home_xg"),
        _played("(cast(floor(o_totalprice) as int) % 270) / 100e0", "away_xg"),
        _played("(cast(floor(o_totalprice) as int) % 280) / 100e0", "home_npxg"),
        _played("(cast(floor(o_totalprice) as int) % 250) / 100e0", "away_npxg"),
        _played("cast(cast(floor(o_totalprice / 3) as int) % 23 as double)", "home_shots"),
        _played("cast(cast(floor(o_totalprice / 3) as int) % 19 as double)", "away_shots"),
        _played("cast(cast(floor(o_totalprice / 7) as int) % 9 as double)", "home_sot"),
        _played("cast(cast(floor(o_totalprice / 7) as int) % 8 as double)", "away_sot"),
        _played("cast(cast(floor(o_totalprice / 11) as int) % 14 as double)", "home_deep"),
        _played("cast(cast(floor(o_totalprice / 11) as int) % 13 as double)", "away_deep"),
        "case when o_orderstatus = 'P' or o_orderkey % 13 = 0 then null "
        "else (cast(floor(o_totalprice / 2) as int) % 200) / 10e0 end as home_ppda",
        "case when o_orderstatus = 'P' or o_orderkey % 17 = 0 then null "
        "else (cast(floor(o_totalprice / 2) as int) % 180) / 10e0 end as away_ppda",
    ]
)

_recipe(
    "matches",
    [],
    f"""select cast(o_orderkey as varchar(20)) as match_id, o_orderkey as match_number,
  o_orderpriority as league_id, concat('League ', o_orderpriority) as league,
  cast(year(o_orderdate) as varchar(4)) as season, o_orderdate as date,
  concat('T', cast(o_custkey % 20 as varchar(4))) as home_team,
  concat('T', cast((o_custkey % 20 + 1 + o_orderkey % 19) % 20 as varchar(4))) as away_team,
  {_MEASURES}
from orders""",
)

# The same matches as a source delivers them: aliased columns, text dates in three forms.
_recipe(
    "raw_matches",
    ["matches"],
    """select match_number as match_id, league_id, league, cast(season as int) as season,
  case when match_number % 97 = 0 then 'n/a'
    when match_number % 3 = 0 then concat(cast(cast(date as date) as varchar(10)), ' 18:30:00')
    when match_number % 3 = 1 then cast(cast(date as date) as varchar(10))
    else concat(cast(cast(date as date) as varchar(10)), 'T20:45:00') end as date,
  home_team as team_h, away_team as team_a, cast(home_goals as varchar(4)) as h_goals, cast(away_goals as varchar(4)) as a_goals,
  home_xg as h_xg, away_xg as a_xg, home_npxg as home_np_xg, away_npxg as away_np_xg,
  cast(home_shots as int) as h_shot, cast(away_shots as int) as a_shot,
  cast(home_deep as int) as home_deep_completions, cast(away_deep as int) as away_deep_completions,
  match_number as note
from matches""",
)

_recipe(
    "elo_history",
    [],
    """select concat('T', cast(l_suppkey % 20 as varchar(4))) as team, date_trunc('month', l_shipdate) as valid_from,
  date_trunc('month', l_shipdate) + interval '24' day as valid_to, 1400 + max(l_extendedprice) / 1000 as elo
from lineitem group by concat('T', cast(l_suppkey % 20 as varchar(4))), date_trunc('month', l_shipdate)""",
)

_recipe(
    "rating_updates",
    [],
    """select concat('T', cast(c_custkey % 50 as varchar(4))) as team, o_orderdate as valid_from, max(o_totalprice) as elo
from orders join customer on o_custkey = c_custkey group by concat('T', cast(c_custkey % 50 as varchar(4))), o_orderdate""",
)

_recipe(
    "rating_snapshots",
    [],
    """select concat('T', cast(c_custkey % 50 as varchar(4))) as team, concat('C', cast(c_nationkey % 6 as varchar(2))) as country,
  o_orderdate as snapshot_date
from orders join customer on o_custkey = c_custkey""",
)

# Some home teams are written in another way, so that their odds find no match.
_recipe(
    "match_history",
    ["matches"],
    """select concat(substring(season, 1, 2), '-', substring(season, 3, 2)) as season,
  case when k % 10 = 0 then concat(home_team, ' FC') else home_team end as home_team, away_team,
  cast(k % 25 as double) as HS, cast(k % 20 as double) as `AS`, cast(k % 9 as double) as HST, cast(k % 8 as double) as AST,
  case when k % 7 = 0 then null else 1.2e0 + (k % 400) / 100e0 end as B365CH,
  case when k % 11 = 0 then null else 1.3e0 + (k % 380) / 100e0 end as B365H,
  case when k % 6 = 0 then null else 2.2e0 + (k % 300) / 100e0 end as B365CD,
  case when k % 13 = 0 then null else 2.3e0 + (k % 280) / 100e0 end as B365D,
  2.1e0 + (k % 350) / 100e0 as B365A,
  case when k % 5 = 0 then null else 1.5e0 + (k % 90) / 100e0 end as `B365C>2.5`,
  case when k % 3 = 0 then null else 1.6e0 + (k % 80) / 100e0 end as `B365>2.5`,
  1.7e0 + (k % 70) / 100e0 as `Avg>2.5`,
  case when k % 4 = 0 then null else 1.8e0 + (k % 60) / 100e0 end as `B365<2.5`
from (select season, home_team, away_team, min(match_number) as k from matches group by season, home_team, away_team) g""",
)

_recipe(
    "predictions",
    ["matches"],
    """select match_id, match_number, league, season, date, home_team, away_team, home_goals, away_goals,
  (match_number % 7 + 1) / cast(match_number % 7 + match_number % 5 + match_number % 3 + 3 as double) as p_h,
  (match_number % 5 + 1) / cast(match_number % 7 + match_number % 5 + match_number % 3 + 3 as double) as p_d,
  (match_number % 3 + 1) / cast(match_number % 7 + match_number % 5 + match_number % 3 + 3 as double) as p_a,
  (match_number % 21) / 20e0 as p_over,
  case when match_number % 29 = 0 then null else 1.5e0 + (match_number % 300) / 100e0 end as odds_h,
  2.5e0 + (match_number % 200) / 100e0 as odds_d, 1.8e0 + (match_number % 250) / 100e0 as odds_a,
  case when match_number % 31 = 0 then null else 1.6e0 + (match_number % 80) / 100e0 end as odds_over,
  1.7e0 + (match_number % 60) / 100e0 as odds_under
from matches""",
)

_recipe(
    "elo_snapshot",
    [],
    """select concat('S', cast(s_suppkey as varchar(20))) as team, concat('C', cast(s_nationkey % 6 as varchar(2))) as country,
  case when s_nationkey % 6 = 0 then null else s_suppkey * 7 % 101 end as rank,
  case when s_nationkey % 6 = 1 then null else 1400 + s_acctbal / 100 end as elo,
  cast(null as int) as level from supplier""",
)

_recipe(
    "elo_snapshot_levels",
    ["elo_snapshot"],
    """select team, country, rank, elo, case when rank is null then null else rank % 3 + 1 end as level
from elo_snapshot""",
)

_recipe(
    "current_ratings",
    [],
    """select concat('T', cast(s_suppkey % 17 as varchar(4))) as team, 1400 + s_acctbal / 100 as elo from supplier""",
)

_recipe(
    "canonical_names", [], "select distinct p_name as name from part"
)

_recipe(
    "raw_names",
    [],
    """select distinct case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then upper(replace(p_name, ' ', '-'))
  when p_partkey % 4 = 2 then substring(p_name, 1, length(p_name) - 1) else concat('zz', cast(p_partkey % 13 as varchar(3)), 'qq') end as raw
from part""",
)

# Overrides: some lead to canonical names, some to names nobody knows.
_recipe(
    "overrides",
    ["raw_names"],
    """select raw, case when raw like 'zz1%' then (select min(p_name) from part) else concat('unknown ', raw) end as canonical
from raw_names where raw like 'zz1%' or raw like 'zz5%' or raw like 'zz7%'""",
)

# Raw rating names ("club 7") and the part of them that has a canonical name.
_recipe(
    "raw_ratings",
    ["elo_history"],
    "select concat('club ', substring(team, 2)) as team, valid_from, valid_to, elo from elo_history",
)
_recipe(
    "rating_names",
    ["elo_history"],
    """select distinct concat('club ', substring(team, 2)) as raw, team as canonical from elo_history
where team <> 'T3' and team <> 'T11'""",
)

# Match names to canonical ones; T1 stays as it is, because the map lacks it.
_recipe(
    "match_names",
    ["matches"],
    """select distinct home_team as raw, concat('Team ', substring(home_team, 2)) as canonical from matches
where home_team <> 'T1'""",
)


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in _ordered(RECIPES[name][0]):
            if need not in out:
                out.append(need)
        if name not in out:
            out.append(name)
    return out


def ctes(names: list[str]) -> str:
    """The recipes and what they need as the text between WITH and the query (DuckDB)."""
    return ",\n".join(f"{n} as ({RECIPES[n][1].replace('`', chr(34))})" for n in _ordered(names))


def oracle(names: list[str], sql: str, recursive: bool = False) -> str:
    """`sql` behind the recipes. It may begin with further CTEs (`name as (...)`)."""
    joint = "" if sql.lstrip().lower().startswith("select") else ","
    return f"with {'recursive ' if recursive else ''}{ctes(names)}{joint}\n{sql}"


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The recipes as DataFrames over the tables in `sf_dir`."""
    apply_settings(spark)
    recipes = _ordered(list(names))
    text = " ".join(RECIPES[name][1] for name in recipes)
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for name in recipes:
        spark.sql(RECIPES[name][1]).createOrReplaceTempView(name)
    return [spark.table(name) for name in names]
