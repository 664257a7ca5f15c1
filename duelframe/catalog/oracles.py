"""The same questions as `queries`, in SQL for DuckDB over the whole tables."""

from __future__ import annotations

from duelframe import constants as K
from duelframe.catalog.fixtures import oracle
from duelframe.catalog.queries import AS_OF, COUNTRIES, COUNTS, READ_SEASON, SINCE

ORACLES: dict[str, str] = {}


def r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def r_as(*names: str) -> str:
    return ", ".join(f"{r(n)} as {n}" for n in names)


def quoted_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def total(terms: list[str]) -> str:
    return " + ".join(terms)


MEASURES = [f"{side}_{m}" for m in ["xg", "npxg", "shots", "sot", "deep", "ppda"] for side in ("home", "away")]

# ---- normalise and ingest ----

ORACLES["normalised_matches"] = oracle(
    ["raw_matches"],
    f"""select cast(match_id as varchar) as match_id, league_id, league, cast(season as varchar) as season,
  try_cast(date as timestamp) as date, team_h as home_team, team_a as away_team,
  cast(h_goals as integer) as home_goals, cast(a_goals as integer) as away_goals,
  {r("h_xg")} as home_xg, {r("a_xg")} as away_xg, {r("home_np_xg")} as home_npxg, {r("away_np_xg")} as away_npxg,
  cast(h_shot as double) as home_shots, cast(a_shot as double) as away_shots,
  cast(home_deep_completions as double) as home_deep, cast(away_deep_completions as double) as away_deep, note
from raw_matches""",
)
ORACLES["landed_matches"] = oracle(
    ["matches"],
    f"""select * replace (replace(league, ' ', '_') as league, {r_as(*MEASURES)}) from matches""",
)
ORACLES["base_match_columns"] = oracle(
    ["matches"],
    f"""select match_id, league_id, league, season, date, home_team, away_team, home_goals, away_goals,
  {r_as(*[m for m in MEASURES if m != "home_sot"])} from matches""",
)
ORACLES["richest_row_dedup"] = oracle(
    ["matches"],
    f"""landed as (
  select *, true as _stats from matches where home_goals is not null
  union all select * replace (null as home_xg), false from matches),
ranked as (select *, row_number() over (partition by league, match_id order by
  (home_goals is not null)::int + (home_xg is not null)::int desc, _stats desc) as place from landed)
select * exclude (_stats, place) replace ({r_as(*MEASURES)}) from ranked where place = 1""",
)
ORACLES["distinct_team_names"] = oracle(
    ["matches", "match_history"],
    """select home_team as name from matches union select away_team from matches
union select home_team from match_history union select away_team from match_history""",
)
_START = "case when month(date) > 6 then year(date) else year(date) - 1 end"
ORACLES["season_labels"] = oracle(
    ["matches"],
    f"""select concat(s, '/', s + 1) as season, concat(s, '-', s + 1) as folder,
  concat(substring(cast(s as varchar), 3), '-', substring(cast(s + 1 as varchar), 3)) as short,
  concat(substring(cast(s as varchar), 3), substring(cast(s + 1 as varchar), 3)) as compact, count(*) as n
from (select {_START} as s from matches) group by s""",
)

# ---- team rows and trailing features ----


def side_select(us: str, them: str, table: str, missing: tuple[str, ...] = ()) -> str:
    parts = [
        "match_id", "league_id", "league", "season", "date", f"{us}_team as team", f"{them}_team as opponent",
        f"{'true' if us == 'home' else 'false'} as is_home", f"'{us[0]}' as side", f"{us}_goals as gf", f"{them}_goals as ga",
    ]
    for m in ["xg", "npxg", "shots", "sot", "deep", "ppda"]:
        for who, suffix in ((us, "for"), (them, "against")):
            source = "cast(null as double)" if m in missing else f"{who}_{m}"
            parts.append(f"{source} as {m}_{suffix}")
    return f"select {', '.join(parts)} from {table}"


def long_ctes(table: str = "matches", missing: tuple[str, ...] = ()) -> str:
    return f"""sides as ({side_select('home', 'away', table, missing)} union all {side_select('away', 'home', table, missing)}),
long as (select *, xg_for - xg_against as xgd, gf - ga as gd, cast(gf > ga as tinyint) as win, cast(gf = ga as tinyint) as draw,
  cast(gf < ga as tinyint) as loss, cast(3 * cast(gf > ga as int) + cast(gf = ga as int) as tinyint) as points from sides)"""


WHOLE = {"gf", "ga", "gd", "points", "win", "draw", "loss"}


def window_clause(windows) -> str:
    return "window " + ", ".join(
        f"w{w} as (partition by league_id, season, team order by date nulls first, match_id nulls first "
        f"rows between {w} preceding and 1 preceding)" for w in windows
    )


def feature_list(scopes, windows, stats, sums=True, games=True) -> list[tuple[str, str]]:
    out = []
    for scope in scopes:
        cond = {"ovr": None, "home": "is_home", "away": "not is_home"}[scope]
        only = lambda x: x if cond is None else f"case when {cond} then {x} end"
        for w in windows:
            for s in stats:
                v = only(s)
                enough = f"count({v}) over w{w} >= 2"
                out.append((f"{scope}__{s}__r{w}", f"case when {enough} then {r(f'avg({v}) over w{w}')} end"))
                if sums:
                    total_ = f"sum({v}) over w{w}"
                    total_ = f"cast({total_} as bigint)" if s in WHOLE else r(total_)
                    out.append((f"{scope}__{s}__sum__r{w}", f"case when {enough} then {total_} end"))
            if games:
                v = only("case when gf is not null then 1 end")
                out.append((f"{scope}__games__r{w}", f"cast(sum({v}) over w{w} as integer)"))
    return out


def features_sql(scopes, windows, stats, sums=True, games=True, keep="match_id, team") -> str:
    columns = ", ".join(f"{sql} as {name}" for name, sql in feature_list(scopes, windows, stats, sums, games))
    return f"select {keep}, {columns} from long {window_clause(windows)}"


def match_level_sql(base: str, base_columns: list[str], scopes, windows, stats, sums=True, games=True) -> str:
    """CTEs `feats` and the match-level select over `base`."""
    names = [n for n, _ in feature_list(scopes, windows, stats, sums, games)]
    return f"""feats as ({features_sql(scopes, windows, stats, sums, games, 'match_id, team, side')}),
ml as (select {', '.join('b.' + c for c in base_columns)}, cast(b.home_goals + b.away_goals > 2.5 as tinyint) as "Over",
  {', '.join(f'h.{n} as {n}__h' for n in names)}, {', '.join(f'a.{n} as {n}__a' for n in names)}
from {base} b left join feats h on h.side = 'h' and b.match_id = h.match_id and b.home_team = h.team
left join feats a on a.side = 'a' and b.match_id = a.match_id and b.away_team = a.team)"""


ORACLES["long_team_rows"] = oracle(
    ["matches"],
    f"""{long_ctes()} select match_id, league_id, league, season, date, team, opponent, is_home, side, gf, ga,
  {r_as(*[f"{m}_{x}" for m in ["xg", "npxg", "shots", "sot", "deep", "ppda"] for x in ("for", "against")], "xgd")},
  gd, win, draw, loss, points from long""",
)
ORACLES["rolling_overall"] = oracle(
    ["matches"], f"{long_ctes()} {features_sql(('ovr',), K.WINDOWS, K.STATS, games=False)}"
)
ORACLES["rolling_venue"] = oracle(
    ["matches"], f"{long_ctes()} {features_sql(('home', 'away'), K.WINDOWS, K.STATS, games=False)}"
)
ORACLES["rolling_games"] = oracle(["matches"], f"{long_ctes()} {features_sql(K.SCOPES, K.WINDOWS, [])}")
ORACLES["rolling_large_groups"] = oracle(
    ["matches"], f"{long_ctes()} {features_sql(K.SCOPES, (3, 5), K.STATS)}"
)
_BASE = [c for c in K.BASE_COLUMNS if c not in K.RESULT_ODDS + K.OVER_ODDS and "elo" not in c]


def rounded_columns(columns: list[str]) -> str:
    return ", ".join(f"{r(c)} as {c}" if c in MEASURES else c for c in columns)


def _all(names: list[str], doubles: set[str]) -> str:
    return ", ".join(f'{r(n)} as "{n}"' if n in doubles else f'"{n}"' for n in names)


_ML_NAMES = [f"{n}__{s}" for s in "ha" for n, _ in feature_list(("ovr",), (5,), K.STATS)]
ORACLES["match_level_features"] = oracle(
    ["matches"],
    f"""{long_ctes()}, {match_level_sql('matches', _BASE, ('ovr',), (5,), K.STATS)}
select {_all(_BASE + ['Over'] + _ML_NAMES, set(MEASURES))} from ml""",
)

# ---- ratings ----

_DAY = "date_trunc('day', date) - interval 1 day"


def asof_ctes(table: str, ratings: str, columns: str = "*") -> str:
    """`rated`: `table` with both ratings and their features."""
    return f"""looked as (select {columns}, cast({_DAY} as timestamp) as _day from {table}),
rated_h as (select l.*, case when l._day > e.valid_to then null else e.elo end as home_elo
  from looked l asof left join {ratings} e on l.home_team = e.team and l._day >= e.valid_from),
rated_a as (select l.*, case when l._day > e.valid_to then null else e.elo end as away_elo
  from rated_h l asof left join {ratings} e on l.away_team = e.team and l._day >= e.valid_from),
rated as (select * exclude (_day), home_elo - away_elo as elo_diff, home_elo + away_elo as elo_sum,
  (home_elo + away_elo) / 2 as elo_mean from rated_a)"""


_SLIM = "match_id, date, home_team, away_team"
_ELO = ["home_elo", "away_elo", "elo_diff", "elo_sum", "elo_mean"]

ORACLES["asof_rating"] = oracle(
    ["matches", "elo_history"],
    f"""asked as (select distinct home_team as team, cast({_DAY} as timestamp) as day from matches)
select a.team, a.day, {r("case when a.day > e.valid_to then null else e.elo end")} as elo
from asked a asof left join elo_history e on a.team = e.team and a.day >= e.valid_from""",
)
ORACLES["asof_rating_both_sides"] = oracle(
    ["matches", "elo_history"], f"{asof_ctes('matches', 'elo_history', _SLIM)} select {_SLIM}, {r_as(*_ELO)} from rated"
)
ORACLES["canonical_ratings"] = oracle(
    ["raw_ratings", "rating_names"],
    f"""select canonical as team, valid_from, valid_to, {r("elo")} as elo
from raw_ratings join rating_names on team = raw""",
)
ORACLES["rating_fill_current"] = oracle(
    ["matches", "elo_history", "current_ratings"],
    f"""{asof_ctes('matches', 'elo_history', _SLIM)},
best as (select team, max(elo) as elo from current_ratings group by team),
filled as (select {', '.join('m.' + c.strip() for c in _SLIM.split(','))}, coalesce(m.home_elo, h.elo) as h, coalesce(m.away_elo, a.elo) as a
  from rated m left join best h on m.home_team = h.team left join best a on m.away_team = a.team)
select {_SLIM}, {r("h")} as home_elo, {r("a")} as away_elo, {r("h - a")} as elo_diff, {r("h + a")} as elo_sum,
  {r("(h + a) / 2")} as elo_mean from filled""",
)
ORACLES["missing_rating_counts"] = oracle(
    ["matches", "elo_history"],
    f"""{asof_ctes('matches', 'elo_history', _SLIM)} select count(*) as rows,
  count(*) filter (home_elo is null) as missing_home_elo, count(*) filter (away_elo is null) as missing_away_elo from rated""",
)
_INTERVALS = """select team, valid_from, elo,
  coalesce(lead(valid_from) over (partition by team order by valid_from) - interval 1 day, timestamp '2000-01-01') as valid_to
from rating_updates"""
ORACLES["interval_from_events"] = oracle(
    ["rating_updates"], f"select team, valid_from, {r('elo')} as elo, valid_to from ({_INTERVALS})"
)
ORACLES["interval_large_groups"] = ORACLES["interval_from_events"]
ORACLES["history_since"] = oracle(
    ["elo_history"],
    f"""select team, valid_from, valid_to, {r('elo')} as elo from elo_history
where valid_from >= timestamp '{SINCE}' or valid_to >= timestamp '{SINCE}'""",
)


def universe_sql(where: str = "") -> str:
    return f"""select team, country from (select team, country,
  row_number() over (partition by team order by snapshot_date, country) as place from rating_snapshots {where}) where place = 1"""


ORACLES["team_universe_first"] = oracle(
    ["rating_snapshots"], universe_sql(f"where country in ({quoted_list(COUNTRIES[:5])})")
)
ORACLES["built_rating_history"] = oracle(
    ["rating_updates", "rating_snapshots"],
    f"""u as ({universe_sql()}), i as ({_INTERVALS})
select i.team, u.country, i.valid_from, i.valid_to, {r('i.elo')} as elo from i left join u on i.team = u.team
where i.valid_from >= timestamp '{SINCE}' or i.valid_to >= timestamp '{SINCE}'""",
)
ORACLES["snapshot_dates_series"] = oracle(
    ["matches"],
    """ends as (select min(date) as first, max(date) as last from matches)
select cast(unnest(generate_series(cast(first as date), cast(last as date), interval 120 day)) as date) as snapshot_date from ends""",
)


def _counts_case(counts: dict[str, int]) -> str:
    return "case country " + " ".join(f"when '{c}' then {n}" for c, n in counts.items()) + f" else {K.DEFAULT_TOP_COUNT} end"


def top_sql(table: str, countries, counts) -> str:
    return f"""flags as (select *, max(rank is not null) over (partition by country) as any_rank,
  max(elo is not null) over (partition by country) as any_elo from {table} where country in ({quoted_list(countries)})),
placed as (select *, row_number() over (partition by country order by
  case when any_rank then rank end nulls last, case when any_rank or any_elo then elo end desc nulls last, team) as place from flags),
top as (select * from placed where place <= {_counts_case(counts)})"""


ORACLES["top_n_per_country"] = oracle(
    ["elo_snapshot"],
    f"""{top_sql('elo_snapshot', COUNTRIES, COUNTS)}
select team, country, cast(rank as double) as rank, {r('elo')} as elo, level from top""",
)
ORACLES["top_division_by_level"] = oracle(
    ["elo_snapshot_levels"],
    f"""{top_sql('elo_snapshot_levels', COUNTRIES[:5], COUNTS)},
base as (select * from elo_snapshot_levels where country in ({quoted_list(COUNTRIES[:5])})),
known as (select max(level is not null) as any_level from base)
select team, country, cast(rank as double) as rank, {r('elo')} as elo, level from base where level = 1 and (select any_level from known)
union all select team, country, cast(rank as double), {r('elo')}, level from top where not (select any_level from known)""",
)
ORACLES["rating_roster"] = oracle(
    ["elo_snapshot"],
    f"""{top_sql('elo_snapshot', COUNTRIES, COUNTS)}
select team as team_clubelo, country, cast(rank as double) as rank, {r('elo')} as elo, '{AS_OF}' as as_of_date,
  concat(country, '-Top') as group_label from top""",
)
ORACLES["selected_rating_histories"] = oracle(
    ["rating_updates", "rating_snapshots"],
    f"""i as ({_INTERVALS}), u as (select team, country, null as rank, length(team) * 1.0 as elo from ({universe_sql()})),
{top_sql('u', COUNTRIES, COUNTS)}
select i.team as team_clubelo, t.country, i.valid_from, i.valid_to, {r('i.elo')} as elo from i join top t on i.team = t.team""",
)

# ---- odds ----

_PREPARED = """prepared as (select replace(season, '-', '') as season, home_team, away_team, HS as home_shots, "AS" as away_shots,
  HST as home_sot, AST as away_sot, coalesce(B365CH, B365H) as odds_h, coalesce(B365CD, B365D) as odds_d, B365A as odds_a,
  coalesce("B365C>2.5", "B365>2.5", "Avg>2.5") as odds_over, "B365<2.5" as odds_under from match_history)"""
_ODDS = K.RESULT_ODDS + K.OVER_ODDS

ORACLES["odds_coalesce_join"] = oracle(
    ["matches", "match_history"],
    f"""{_PREPARED}
select m.match_id, m.season, m.home_team, m.away_team, {', '.join(f'{r("o." + c)} as {c}' for c in ["home_shots", "away_shots", "home_sot", "away_sot", *_ODDS])}
from matches m left join prepared o on m.season = o.season and m.home_team = o.home_team and m.away_team = o.away_team""",
)
_IMPLIED = {
    "h": "(1 / odds_h) / (1 / odds_h + 1 / odds_d + 1 / odds_a)",
    "d": "(1 / odds_d) / (1 / odds_h + 1 / odds_d + 1 / odds_a)",
    "a": "(1 / odds_a) / (1 / odds_h + 1 / odds_d + 1 / odds_a)",
    "over": "(1 / odds_over) / (1 / odds_over + 1 / odds_under)",
    "under": "(1 / odds_under) / (1 / odds_over + 1 / odds_under)",
}
ORACLES["implied_probabilities"] = oracle(
    ["matches", "match_history"],
    f"""{_PREPARED} select season, home_team, away_team,
  {', '.join(f'{r(sql)} as implied_{n}' for n, sql in _IMPLIED.items())} from prepared""",
)
ORACLES["odds_coverage"] = oracle(
    ["matches", "match_history"],
    f"""{_PREPARED} select count(*) as rows,
  count(*) filter ({' and '.join(f'o.{c} is not null' for c in _ODDS)}) as rows_with_odds
from matches m left join prepared o on m.season = o.season and m.home_team = o.home_team and m.away_team = o.away_team""",
)

# ---- names ----


def normal(name: str) -> str:
    return f"replace(replace(replace(trim(lower({name})), ' ', ''), '.', ''), '-', '')"


ORACLES["name_normalize"] = oracle(
    ["raw_names"], f"select raw, {normal('raw')} as normalised, replace(raw, ' ', '_') as path from raw_names"
)
ORACLES["replaced_names"] = oracle(
    ["matches", "match_names"],
    """select match_id, coalesce(h.canonical, home_team) as home_team, coalesce(a.canonical, away_team) as away_team
from matches left join match_names h on home_team = h.raw left join match_names a on away_team = a.raw""",
)
ORACLES["unmatched_names"] = oracle(
    ["raw_names", "canonical_names"], "select raw as name from raw_names except select name from canonical_names"
)

# Matching blocks by recursion: the longest common substring (earliest in the candidate,
# then in the word) splits a pair of segments into the two left and right of it.
_BLOCKS = """blocks as (
  select r.raw as word, c.name as candidate, c.name as a, r.raw as b, 0 as k from raw_names r, canonical_names c
  union all
  select word, candidate, unnest([substr(a, 1, i - 1), substr(a, i + l)]), unnest([substr(b, 1, j - 1), substr(b, j + l)]), unnest([l, 0])
  from (select *, strpos(b, substr(a, i, l)) as j from (select word, candidate, a, b, best.l as l, -best.ni as i from (
    select word, candidate, a, b, list_max(flatten([[{'l': l, 'ni': -i} for l in range(1, length(a) - i + 2) if strpos(b, substr(a, i, l)) > 0]
      for i in range(1, length(a) + 1)])) as best from blocks where a <> '' and b <> '')
  where best is not null))),
scores as (select word, candidate, 2.0 * sum(k) / (length(word) + length(candidate)) as score from blocks group by word, candidate),
closest as (select word, arg_max(candidate, (score, candidate)) as candidate, max(score) as score from scores group by word)"""

ORACLES["similar_name_pairs"] = oracle(
    ["raw_names", "canonical_names"],
    f"{_BLOCKS} select word, candidate, {r('cast(score as double)')} as score from scores where score >= {K.FUZZY_CUTOFF}",
    recursive=True,
)
ORACLES["closest_names"] = oracle(
    ["raw_names", "canonical_names"],
    f"{_BLOCKS} select word, candidate, {r('cast(score as double)')} as score from closest where score >= {K.FUZZY_CUTOFF}",
    recursive=True,
)
ORACLES["resolve_first_source"] = oracle(
    ["raw_names", "overrides"],
    """select r.raw, coalesce(o.canonical, r.raw) as canonical, case when o.raw is null then 'identity' else 'override' end as method
from raw_names r left join overrides o on r.raw = o.raw""",
)
_STEPS = f"""offers as (select r.raw, o.canonical as given, k.name as known, e.name as exact, n.name as normalised
  from raw_names r left join overrides o on r.raw = o.raw left join canonical_names k on o.canonical = k.name
  left join canonical_names e on r.raw = e.name
  left join (select {normal('name')} as key, min(name) as name from canonical_names group by 1) n on {normal('r.raw')} = n.key)"""


def cascade_sql(cases: list[tuple[str, str, str]], cutoff: float, last: str, last_method: str) -> str:
    near = f"c.score >= {cutoff}"
    canonical = " ".join(f"when {cond} then {value}" for cond, value, _ in cases)
    method = " ".join(f"when {cond} then '{name}'" for cond, _, name in cases)
    return oracle(
        ["raw_names", "canonical_names", "overrides"],
        f"""{_BLOCKS}, {_STEPS}
select o.raw, case {canonical} when {near} then c.candidate else {last} end as canonical,
  case {method} when {near} then 'fuzzy' else '{last_method}' end as method
from offers o left join closest c on o.raw = c.word""",
        recursive=True,
    )


_EXACT = ("exact is not null", "exact", "exact")
_NORMALISED = ("normalised is not null", "normalised", "normalised")
ORACLES["resolve_second_source"] = cascade_sql(
    [("given is not null", "given", "override"), _EXACT, _NORMALISED], K.FUZZY_CUTOFF, "o.raw", "identity"
)
ORACLES["resolve_rating_source"] = cascade_sql(
    [_EXACT, ("known is not null", "known", "override"), ("given is not null", "null", "override_target_missing")],
    K.FUZZY_CUTOFF_STRICT, "null", "unmatched",
)
ORACLES["resolve_source_pair"] = cascade_sql(
    [_EXACT, _NORMALISED, ("known is not null", "known", "override")], K.FUZZY_CUTOFF, "null", "unmatched"
)

# ---- modelling on tables ----

_RESULT = "case when home_goals > away_goals then 'H' when home_goals < away_goals then 'A' else 'D' end"
_OVER = "cast(home_goals + away_goals > 2.5 as tinyint)"
_SPLIT = """seasons as (select season, row_number() over (order by season desc) as n from (select distinct season from matches)),
split as (select season, case n when 1 then 'excluded' when 2 then 'validation' else 'train' end as split from seasons)"""

ORACLES["result_targets"] = oracle(
    ["matches"], f'select match_id, home_goals, away_goals, {_OVER} as "Over", {_RESULT} as match_result from matches'
)
ORACLES["season_split"] = oracle(
    ["matches"],
    f"{_SPLIT} select m.season, s.split, count(*) as n from matches m join split s on m.season = s.season group by all",
)
_MODEL = f"{long_ctes()}, {match_level_sql('matches', _BASE, ('ovr',), (5,), K.STATS, sums=False)}"
_ENOUGH = "ovr__games__r5__h >= 5 and ovr__games__r5__a >= 5"
_MODEL_FEATURES = sorted(f"ovr__{s}__r5__{side}" for s in K.STATS for side in "ha")
ORACLES["min_history_filter"] = oracle(
    ["matches"], f"{_MODEL} select match_id, ovr__games__r5__h, ovr__games__r5__a from ml where {_ENOUGH}"
)
ORACLES["model_matrix"] = oracle(
    ["matches"],
    f"""{_MODEL}, {_SPLIT.replace('from matches', 'from ml where ' + _ENOUGH)}
select match_id, split, {_RESULT} as match_result, "Over", {', '.join(_MODEL_FEATURES)} from ml join split on ml.season = split.season
where {_ENOUGH} and {' and '.join(f'{f} is not null' for f in _MODEL_FEATURES)}""",
)

# ---- evaluation ----

_PICK = "case when p_a >= p_d and p_a >= p_h then 'A' when p_d >= p_h then 'D' else 'H' end"


def judged(name: str = "j", p_over: str = "p_over") -> str:
    """CTE with truth, picks and bets."""
    return f"""{name}0 as (select * exclude (p_over), {p_over} as p_over, {_OVER} as y_over, {_RESULT} as y_res, {_PICK} as pick
  from predictions where home_goals is not null),
{name}1 as (select *, case pick when 'A' then p_a when 'D' then p_d else p_h end * case pick when 'A' then odds_a when 'D' then odds_d else odds_h end - 1 as ev_res,
  case pick when 'A' then odds_a when 'D' then odds_d else odds_h end as pick_odds, p_over > 1 - p_over as is_over from {name}0),
{name}2 as (select *, case when is_over then odds_over else odds_under end as ou_odds,
  case when is_over then p_over else 1 - p_over end * case when is_over then odds_over else odds_under end - 1 as ev_over from {name}1),
{name} as (select *, case when ev_res > 0 then case when pick = y_res then pick_odds - 1 else -1.0 end end as profit_res,
  case when ev_over > 0 then case when is_over::int = y_over then ou_odds - 1 else -1.0 end end as profit_over from {name}2)"""


_CLASSES = """pairs as (select y_res as t, pick as p, count(*) as n from j group by all),
labels as (select t as label from pairs union select p from pairs),
cls as (select label, coalesce(sum(n) filter (t = label and p = label), 0) as tp, coalesce(sum(n) filter (t = label), 0) as actual,
  coalesce(sum(n) filter (p = label), 0) as predicted from labels, pairs group by label)"""
ORACLES["class_f1_scores"] = oracle(
    ["predictions"],
    f"""{judged()}, {_CLASSES} select label, cast(tp as bigint) as tp, cast(actual as bigint) as actual,
  cast(predicted as bigint) as predicted, {r('2 * tp / (actual + predicted)')} as f1 from cls""",
)
ORACLES["result_metrics"] = oracle(
    ["predictions"],
    f"""{judged()}, {_CLASSES} select {r('(select avg((pick = y_res)::int) from j)')} as accuracy,
  {r('avg(2 * tp / (actual + predicted))')} as macro_f1 from cls""",
)
_TRUE_P = "case when y_over = 1 then p_over else 1 - p_over end"
ORACLES["over_metrics"] = oracle(
    ["predictions"],
    f"""{judged()} select {r('avg(((p_over >= 0.5)::int = y_over)::int)')} as accuracy, {r('avg(pow(p_over - y_over, 2))')} as brier,
  {r(f'-avg(ln(greatest(least({_TRUE_P}, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))')} as log_loss from j""",
)
ORACLES["prob_correlation"] = oracle(
    ["predictions"],
    f"{judged()} select {r('corr(p_h, ' + _IMPLIED['h'] + ')')} as corr_h, {r('corr(p_over, ' + _IMPLIED['over'] + ')')} as corr_over from j",
)


def betting_sql(ev: str, profit: str) -> str:
    return oracle(
        ["predictions"],
        f"""{judged()}, s as (select count(*) as games, count(*) filter ({ev} > 0) as bets, coalesce(sum({profit}), 0) as profit from j)
select games, bets, {r('cast(profit as double)')} as total_profit, {r('case when bets > 0 then profit / bets else 0e0 end')} as avg_return,
  {r('case when games > 0 then bets / games else 0e0 end')} as bet_share from s""",
    )


ORACLES["betting_result"] = betting_sql("ev_res", "profit_res")
ORACLES["betting_over"] = betting_sql("ev_over", "profit_over")


def _comparison(model: str, table: str) -> str:
    figures = {
        ("result", "accuracy"): "avg((pick = y_res)::int)",
        ("result", "correlation"): f"corr(p_h, {_IMPLIED['h']})",
        ("result", "bets"): "count(*) filter (ev_res > 0)",
        ("result", "profit"): "coalesce(sum(profit_res), 0)",
        ("result", "roi"): "coalesce(sum(profit_res) / nullif(count(*) filter (ev_res > 0), 0), 0)",
        ("over", "accuracy"): "avg(((p_over >= 0.5)::int = y_over)::int)",
        ("over", "correlation"): f"corr(p_over, {_IMPLIED['over']})",
        ("over", "bets"): "count(*) filter (ev_over > 0)",
        ("over", "profit"): "coalesce(sum(profit_over), 0)",
        ("over", "roi"): "coalesce(sum(profit_over) / nullif(count(*) filter (ev_over > 0), 0), 0)",
    }
    return " union all ".join(
        f"select '{model}' as model, '{t}' as target, '{m}' as metric, {r(f'cast({sql} as double)')} as value from {table}"
        for (t, m), sql in figures.items()
    )


ORACLES["model_comparison"] = oracle(
    ["predictions"],
    f"{judged('j')}, {judged('k', 'p_over * 0.5e0 + 0.25e0')} {_comparison('A', 'j')} union all {_comparison('B', 'k')}",
)

# ---- report ----

ORACLES["coming_matches"] = oracle(
    ["matches"],
    "select match_id, date from matches where date >= timestamp '1997-07-14' and date < timestamp '1997-07-18'",
)


def even(x: str, digits: int) -> str:
    return f"round_even({x} * 1e{digits}, 0) / 1e{digits}"


def text_odds(p: str) -> str:
    return f"case when {p} = 0 then 'inf' else cast(cast({even(f'(1 / {p})', 2)} as decimal(20, 2)) as varchar) end"


_LOCAL = "((date at time zone 'UTC') at time zone 'Europe/Athens')"
ORACLES["prediction_report"] = oracle(
    ["predictions"],
    f"""select strftime({_LOCAL}, '%Y-%m-%d') as "Day", strftime({_LOCAL}, '%H:%M') as "Time", league, home_team, away_team,
  {_PICK} as "Result_Pred",
  {', '.join(f'{r(even("p_" + c.lower(), 3))} as "Prob_{c}", {r(even("(1 / p_" + c.lower() + ")", 2))} as "Odds_{c}", {r("odds_" + c.lower())} as "Bookie_{c}"' for c in "HDA")},
  case when p_over >= 0.5 then 'Over' else 'Under' end as "Over_Under_Pred",
  {r(even('p_over', 3))} as "Prob_Over_2.5", {text_odds('p_over')} as "Odds_Over_2.5", {r('odds_over')} as "Bookie_Over",
  {r(even('(1 - p_over)', 3))} as "Prob_Under_2.5", {text_odds('(1 - p_over)')} as "Odds_Under_2.5", {r('odds_under')} as "Bookie_Under"
from predictions""",
)

# ---- whole jobs ----

_TRAINING = f"""named as (select cast(match_id as varchar) as match_id, league_id, league, cast(season as varchar) as season,
    try_cast(date as timestamp) as date, coalesce(h.canonical, team_h) as home_team, coalesce(a.canonical, team_a) as away_team,
    cast(h_goals as int) as home_goals, cast(a_goals as int) as away_goals, h_xg as home_xg, a_xg as away_xg,
    home_np_xg as home_npxg, away_np_xg as away_npxg,
    cast(home_deep_completions as double) as home_deep, cast(away_deep_completions as double) as away_deep
  from raw_matches left join match_names h on team_h = h.raw left join match_names a on team_a = a.raw),
ratings as (select coalesce(n.canonical, m.canonical) as team, valid_from, valid_to, elo
  from raw_ratings join rating_names m on team = m.raw left join match_names n on m.canonical = n.raw),
{asof_ctes('named', 'ratings')},
{_PREPARED},
o as (select p.* replace (coalesce(h.canonical, home_team) as home_team, coalesce(a.canonical, away_team) as away_team)
  from prepared p left join match_names h on home_team = h.raw left join match_names a on away_team = a.raw),
tb as (select m.*, o.home_shots, o.away_shots, o.home_sot, o.away_sot, o.odds_h, o.odds_d, o.odds_a, o.odds_over, o.odds_under
  from rated m left join o on m.season = o.season and m.home_team = o.home_team and m.away_team = o.away_team)"""
_TRAINING_NEEDS = ["raw_matches", "match_names", "match_history", "raw_ratings", "rating_names"]
_TB = [c for c in K.BASE_COLUMNS if "ppda" not in c]
_TB_DOUBLES = set(MEASURES) | set(_ODDS) | set(_ELO)

ORACLES["training_base"] = oracle(_TRAINING_NEEDS, f"{_TRAINING} select {_all(_TB, _TB_DOUBLES)} from tb")
_TF_NAMES = [f"{n}__{s}" for s in "ha" for n, _ in feature_list(K.SCOPES, K.WINDOWS, K.STATS)]
ORACLES["training_features"] = oracle(
    _TRAINING_NEEDS,
    f"""{_TRAINING}, {long_ctes('tb', missing=('ppda',))}, {match_level_sql('tb', _TB, K.SCOPES, K.WINDOWS, K.STATS)}
select {_all(_TB + ['Over'] + _TF_NAMES, _TB_DOUBLES)} from ml""",
)

# ---- sinks and sources ----

ORACLES["match_tree_rewrite"] = oracle(
    ["matches"],
    """select match_id, replace(league, ' ', '_') as league, cast(season as varchar) as season,
  case when season = (select max(season) from matches) then home_goals + 1 else home_goals end as home_goals, away_goals
from matches""",
)
ORACLES["match_tree_scan"] = oracle(
    ["matches"],
    f"""select cast(season as varchar) as season, count(*) as rows, count(distinct league) as folders,
  count(home_xg) filter (where substring(league, 8, 1) not in ('1', '3', '5')) as with_xg, sum(home_goals)::bigint as goals
from matches where season = '{READ_SEASON}' group by season""",
)
ORACLES["snapshot_rewrite"] = oracle(
    ["elo_snapshot"],
    f"""select team, country, {r("elo")} as elo, '2024-01-01' as as_of_date from elo_snapshot
union all select team, country, {r("elo + 5")}, '2024-02-01' from elo_snapshot where country <> 'C2'""",
)
ORACLES["ordered_csv"] = oracle(
    ["matches"],
    """select match_id, home_team, row_number() over (order by home_team nulls first, match_id nulls first) - 1 as position
from matches""",
)
ORACLES["name_map_round_trip"] = """select concat_ws(' ', upper(c_name), '"quoted"', c_mktsegment) as raw, c_name as canonical from customer"""
ORACLES["guarded_matches"] = oracle(
    ["matches"], "select season, count(*) as n, sum(home_goals)::bigint as goals from matches group by season"
)
ORACLES["season_names"] = oracle(
    ["matches"],
    f"""wanted as (select unnest(range(1994, year(date '{AS_OF}') + case when month(date '{AS_OF}') >= 7 then 1 else 0 end)) as y)
select y::int as start_year, y || '/' || (y + 1) as season, y || '-' || (y + 1) as folder,
  printf('%02d-%02d', (y % 100)::int, ((y + 1) % 100)::int) as short, count(match_id) as n
from wanted left join matches on season = y::varchar group by y""",
)
