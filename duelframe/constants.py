"""Values a result depends on. Everything else in the library takes them as parameters."""

# ---- Fixed values: names, windows and thresholds that results must agree on ----

# Alternative column names in raw match tables -> internal name.
COLUMN_ALIASES = {
    "team_h": "home_team",
    "team_a": "away_team",
    "h_goals": "home_goals",
    "a_goals": "away_goals",
    "h_xg": "home_xg",
    "a_xg": "away_xg",
    "h_shot": "home_shots",
    "a_shot": "away_shots",
    "h_shotOnTarget": "home_sot",
    "a_shotOnTarget": "away_sot",
    "h_deep": "home_deep",
    "a_deep": "away_deep",
    "h_ppda": "home_ppda",
    "a_ppda": "away_ppda",
    "home_deep_completions": "home_deep",
    "away_deep_completions": "away_deep",
    "home_np_xg": "home_npxg",
    "away_np_xg": "away_npxg",
}

# Names used by the landed per-season statistics files (after lower-casing).
LANDED_ALIASES = {
    "home_shot": "home_shots",
    "away_shot": "away_shots",
    "home_shotontarget": "home_sot",
    "away_shotontarget": "away_sot",
    "game": "match_id",
}

MATCH_TYPES = {
    "id": "string",
    "fid": "string",
    "match_id": "string",
    "league_id": "string",
    "league": "string",
    "season": "string",
    "home_team": "string",
    "away_team": "string",
    "home_goals": "int",
    "away_goals": "int",
    "home_xg": "double",
    "away_xg": "double",
    "home_npxg": "double",
    "away_npxg": "double",
    "home_shots": "double",
    "away_shots": "double",
    "home_sot": "double",
    "away_sot": "double",
    "home_deep": "double",
    "away_deep": "double",
    "home_ppda": "double",
    "away_ppda": "double",
}

# Columns of the match-level base table, in order (31).
BASE_COLUMNS = [
    "match_id", "league_id", "league", "season", "date", "home_team", "away_team",
    "home_goals", "away_goals", "home_xg", "away_xg", "home_npxg", "away_npxg",
    "home_shots", "away_shots", "home_sot", "away_sot", "home_deep", "away_deep",
    "home_ppda", "away_ppda",
    "odds_h", "odds_d", "odds_a", "odds_over", "odds_under",
    "home_elo", "away_elo", "elo_diff", "elo_sum", "elo_mean",
]

# Per-side measures of a match; each gives a `_for` and an `_against` column per team row.
SIDE_MEASURES = ["xg", "npxg", "shots", "sot", "deep", "ppda"]

# The 20 statistics of a team row that trailing features are built from.
STATS_FOR = ["xg_for", "npxg_for", "shots_for", "sot_for", "deep_for", "ppda_for", "gf"]
STATS_AGAINST = [
    "xg_against", "npxg_against", "shots_against", "sot_against", "deep_against", "ppda_against", "ga",
]
DERIVED_STATS = ["xgd", "gd", "points", "win", "draw", "loss"]
STATS = STATS_FOR + STATS_AGAINST + DERIVED_STATS

WINDOWS = (3, 5, 10)
SCOPES = ("ovr", "home", "away")
MIN_VALUES = 2          # non-null values a trailing mean or sum needs
MIN_GAMES = 1           # played games the games counter needs

GROUP_KEYS = ["league_id", "season", "team"]
ORDER_KEYS = ["date", "match_id"]

# Odds columns by precedence, first non-null wins.
ODDS_PRECEDENCE = {
    "odds_h": ["B365CH", "B365H"],
    "odds_d": ["B365CD", "B365D"],
    "odds_a": ["B365CA", "B365A"],
    "odds_over": ["B365C>2.5", "B365>2.5", "Avg>2.5", "BbAv>2.5"],
    "odds_under": ["B365C<2.5", "B365<2.5", "Avg<2.5", "BbAv<2.5"],
}
ODDS_STAT_COLUMNS = {"HS": "home_shots", "AS": "away_shots", "HST": "home_sot", "AST": "away_sot"}
RESULT_ODDS = ["odds_h", "odds_d", "odds_a"]
OVER_ODDS = ["odds_over", "odds_under"]

RATING_COLUMNS = ["elo_diff", "elo_sum", "elo_mean"]
RESULT_CLASSES = ["A", "D", "H"]
OVER_LINE = 2.5

FRONT_COLUMNS = [
    "match_id", "league_id", "league", "season", "date",
    "home_team", "away_team", "home_goals", "away_goals", "Over",
]

HISTORY_WINDOW = 5      # window of the model features and of the history filter
HISTORY_GAMES = 5       # prior games both sides need for training

SNAPSHOT_START = "2014-01-01"
SNAPSHOT_STEP_DAYS = 120
RATING_COUNTRIES = ["GER", "ESP", "ENG", "ITA", "FRA"]
TOP_COUNTS = {"ENG": 20, "ESP": 20, "GER": 18, "ITA": 20, "FRA": 18, "RUS": 16}
DEFAULT_TOP_COUNT = 20

FIRST_SEASON_YEAR = 2014

FUZZY_CUTOFF = 0.6
FUZZY_CUTOFF_STRICT = 0.85

REPORT_DAYS = 4
REPORT_TIME_ZONE = "Europe/Athens"
REPORT_COLUMNS = [
    "Day", "Time", "league", "home_team", "away_team",
    "Result_Pred", "Prob_H", "Odds_H", "Bookie_H", "Prob_D", "Odds_D", "Bookie_D",
    "Prob_A", "Odds_A", "Bookie_A",
    "Over_Under_Pred", "Prob_Over_2.5", "Odds_Over_2.5", "Bookie_Over",
    "Prob_Under_2.5", "Odds_Under_2.5", "Bookie_Under",
]
BOOKMAKER_COLUMNS = {
    "odds_h": "Bookie_H",
    "odds_d": "Bookie_D",
    "odds_a": "Bookie_A",
    "odds_over": "Bookie_Over",
    "odds_under": "Bookie_Under",
}

# Boosting parameters, tuned values.
BOOSTING = {
    "trees": 491,
    "rate": 0.01110442342472048,
    "depth": 13,
    "leaves": 54,
    "min_rows": 26,
    "rows": 0.9705203514053395,
    "columns": 0.679486272613669,
    "l1": 0.7901755405312056,
    "l2": 0.6059599747810114,
    "seed": 42,
}
# ---- end of fixed values ----
