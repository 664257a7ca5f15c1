"""One registered query per operator or job. Each reads its tables whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.catalog.fixtures import load
from duelframe.functions.columns import quoted, sql_name
from duelframe.functions.dates import (
    compact_season,
    day_before,
    season_label,
    season_list,
    season_start_year,
    short_season_label,
    snapshot_dates,
)
from duelframe.functions.text import normalised_name, path_key
from duelframe.operators import asof, evaluate, history, ingest, mapping, matchlevel, modelling, odds, report
from duelframe.operators import normalize as norm
from duelframe.operators import resolve, rolling, similarity, snapshot
from duelframe.operators.checks import file_positions, guard_rows, missing_counts
from duelframe.plans import features as feature_plan
from duelframe.plans.predict import predict_coming
from duelframe.plans.train import train_and_compare
from duelframe.session import ensure_checkpoint_dir
from duelframe.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
PLAIN: dict[str, Query] = {}      # as the operators return it
QUERIES: dict[str, Query] = {}    # made comparable between engines

DIGITS = 6
COUNTRIES = [f"C{i}" for i in range(6)]
COUNTS = {"C0": 6, "C1": 5, "C2": 4, "C4": 3}
AS_OF = "1998-08-10"
SINCE = "1995-03-01"
READ_SEASON = "1998"
PIECES = 48


def query(f: Query) -> Query:
    PLAIN[f.__name__] = f
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
    return f


def rounded(c: str) -> str:
    """`round(c, DIGITS)` as SQL text. `round` goes through decimal text, some microsecond a value;
    up to a million the nearest integer of the scaled value gives the same double, unless that
    lies so near a half that the digits must decide. Null and NaN take the last branch."""
    scaled = f"{c} * 1e{DIGITS}D"
    return f"if(abs({c}) < 1e6D and abs({scaled} - rint({scaled})) < 0.49D, rint({scaled}) / 1e{DIGITS}D, round({c}, {DIGITS}))"


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles (engines add in different orders; + 0.0 turns -0.0 into 0.0) and
    give timestamps one type."""
    out = []
    for name, type_ in df.dtypes:
        c = sql_name(name)
        if type_ == "double":
            out.append(f"{rounded(c)} + 0.0D as {c}")
        elif type_.startswith("timestamp"):
            out.append(f"cast({c} as timestamp_ntz) as {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


def _long(spark, sf, *more):
    matches, *rest = load(spark, sf, "matches", *more)
    return matches, rolling.team_rows(matches), rest


# ---- normalise and ingest ----


@query
def normalised_matches(spark, sf):
    (raw,) = load(spark, sf, "raw_matches")
    return norm.normalise_matches(raw)


@query
def landed_matches(spark, sf):
    (matches,) = load(spark, sf, "matches")
    landed = matches.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")).withColumnsRenamed(
        {"match_id": "GAME", "league": "League", "date": "Date", "home_shots": "Home_Shot", "away_sot": "Away_ShotOnTarget"}
    )
    return norm.with_path_keys(norm.normalise_landed(landed), ["league"])


@query
def base_match_columns(spark, sf):
    (matches,) = load(spark, sf, "matches")
    return norm.base_matches(norm.drop_existing(matches, ["home_sot", "absent"]))


@query
def richest_row_dedup(spark, sf):
    (matches,) = load(spark, sf, "matches")
    return feature_plan.combine_landed([matches.filter("home_goals is not null")], [matches.drop("home_xg")])


@query
def distinct_team_names(spark, sf):
    matches, mh = load(spark, sf, "matches", "match_history")
    return mapping.distinct_names(matches, mh)


@query
def season_labels(spark, sf):
    (matches,) = load(spark, sf, "matches")
    start = season_start_year(F.col("date"))
    return (
        matches.groupBy(
            season_label(start).alias("season"),
            season_label(start, "-").alias("folder"),
            short_season_label(start).alias("short"),
            compact_season(short_season_label(start)).alias("compact"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- team rows and trailing features ----


@query
def long_team_rows(spark, sf):
    _, rows, _ = _long(spark, sf)
    return rows


def _features_only(df):
    return df.selectExpr("match_id", "team", *rolling.feature_columns(df.columns))


@query
def rolling_overall(spark, sf):
    _, rows, _ = _long(spark, sf)
    return _features_only(rolling.trailing_features(rows, scopes=("ovr",), games=False))


@query
def rolling_venue(spark, sf):
    _, rows, _ = _long(spark, sf)
    return _features_only(rolling.trailing_features(rows, scopes=("home", "away"), games=False))


@query
def rolling_games(spark, sf):
    _, rows, _ = _long(spark, sf)
    return _features_only(rolling.trailing_features(rows, stats=[]))


@query
def rolling_large_groups(spark, sf):
    """The way for groups too long for one task: sequences cut into pieces."""
    _, rows, _ = _long(spark, sf)
    return _features_only(rolling.trailing_features(rows, windows=(3, 5), pieces=PIECES))


@query
def match_level_features(spark, sf):
    matches, rows, _ = _long(spark, sf)
    base = norm.base_matches(matches)
    return matchlevel.match_features(base, rolling.trailing_features(rows, windows=(5,), scopes=("ovr",)))


# ---- ratings ----


@query
def asof_rating(spark, sf):
    matches, ratings = load(spark, sf, "matches", "elo_history")
    lookups = matches.select(F.col("home_team").alias("team"), day_before(F.col("date")).alias("day"))
    return asof.rating_on_day(lookups, ratings)


@query
def asof_rating_both_sides(spark, sf):
    matches, ratings = load(spark, sf, "matches", "elo_history")
    slim = matches.select("match_id", "date", "home_team", "away_team")
    return asof.attach_ratings(slim, ratings)


@query
def canonical_ratings(spark, sf):
    ratings, names = load(spark, sf, "raw_ratings", "rating_names")
    return mapping.canonical_only(ratings, names, "team")


@query
def rating_fill_current(spark, sf):
    matches, ratings, current = load(spark, sf, "matches", "elo_history", "current_ratings")
    slim = matches.select("match_id", "date", "home_team", "away_team")
    return asof.fill_current_ratings(asof.attach_ratings(slim, ratings), current)


@query
def missing_rating_counts(spark, sf):
    matches, ratings = load(spark, sf, "matches", "elo_history")
    slim = matches.select("match_id", "date", "home_team", "away_team")
    return missing_counts(asof.attach_ratings(slim, ratings), ["home_elo", "away_elo"])


@query
def interval_from_events(spark, sf):
    (updates,) = load(spark, sf, "rating_updates")
    return history.with_interval_end(updates, F.lit("2000-01-01").cast("timestamp_ntz"))


@query
def interval_large_groups(spark, sf):
    (updates,) = load(spark, sf, "rating_updates")
    return history.with_interval_end(updates, F.lit("2000-01-01").cast("timestamp_ntz"), pieces=PIECES)


@query
def history_since(spark, sf):
    (ratings,) = load(spark, sf, "elo_history")
    return history.since(ratings, F.lit(SINCE).cast("timestamp_ntz"))


@query
def team_universe_first(spark, sf):
    (snapshots,) = load(spark, sf, "rating_snapshots")
    return history.team_universe(norm.in_list(snapshots, "country", COUNTRIES[:5]))


@query
def built_rating_history(spark, sf):
    updates, snapshots = load(spark, sf, "rating_updates", "rating_snapshots")
    lone_end = updates.select("team", F.col("valid_from").cast("string").alias("to"), F.col("elo").cast("string").alias("elo"))
    return (
        history.build_history(
            lone_end, F.lit("2000-01-01").cast("timestamp_ntz"), F.lit(SINCE).cast("timestamp_ntz"),
            history.team_universe(snapshots),
        )
    )


@query
def snapshot_dates_series(spark, sf):
    (matches,) = load(spark, sf, "matches")
    ends = matches.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return ends.select(F.explode(snapshot_dates(F.col("first"), F.col("last"))).alias("snapshot_date"))


@query
def top_n_per_country(spark, sf):
    (table,) = load(spark, sf, "elo_snapshot")
    return snapshot.top_division(table, COUNTRIES, COUNTS)


@query
def top_division_by_level(spark, sf):
    (table,) = load(spark, sf, "elo_snapshot_levels")
    return snapshot.top_division(table, COUNTRIES[:5], COUNTS)


@query
def rating_roster(spark, sf):
    (table,) = load(spark, sf, "elo_snapshot")
    asof_table = snapshot.asof_snapshot(snapshot.top_division(table, COUNTRIES, COUNTS), AS_OF)
    return (
        asof_table.join(snapshot.roster(asof_table).drop("country"), "team_clubelo")
    )


@query
def selected_rating_histories(spark, sf):
    updates, snapshots = load(spark, sf, "rating_updates", "rating_snapshots")
    full = history.with_interval_end(updates, F.lit("2000-01-01").cast("timestamp_ntz"))
    table = history.team_universe(snapshots).withColumn("elo", F.length("team") * 1.0)
    asof_table = snapshot.asof_snapshot(snapshot.top_division(table, COUNTRIES, COUNTS), AS_OF)
    return history.selected_histories(full, asof_table)


# ---- odds ----


@query
def odds_coalesce_join(spark, sf):
    matches, mh = load(spark, sf, "matches", "match_history")
    joined = odds.attach_odds(matches, odds.prepare_odds(mh))
    return (
        joined.select("match_id", *odds.MATCH_KEY, *odds.SHOT_COLUMNS, *K.RESULT_ODDS, *K.OVER_ODDS)
    )


@query
def implied_probabilities(spark, sf):
    _, mh = load(spark, sf, "matches", "match_history")
    return (
        odds.with_implied_probabilities(odds.prepare_odds(mh)).select(
            *odds.MATCH_KEY, "implied_h", "implied_d", "implied_a", "implied_over", "implied_under"
        )
    )


@query
def odds_coverage(spark, sf):
    matches, mh = load(spark, sf, "matches", "match_history")
    return modelling.odds_coverage(odds.attach_odds(matches, odds.prepare_odds(mh)))


# ---- names ----


@query
def name_normalize(spark, sf):
    (raw,) = load(spark, sf, "raw_names")
    return raw.select("raw", normalised_name(F.col("raw")).alias("normalised"), path_key(F.col("raw")).alias("path"))


@query
def replaced_names(spark, sf):
    matches, names = load(spark, sf, "matches", "match_names")
    return mapping.replace_names(
        matches.select("match_id", "home_team", "away_team"), names, ["home_team", "away_team"]
    )


@query
def unmatched_names(spark, sf):
    raw, known = load(spark, sf, "raw_names", "canonical_names")
    return mapping.unmatched_names(raw.select(F.col("raw").alias("name")), known)


def _resolved(spark, sf, cascade):
    raw, known, overrides = load(spark, sf, "raw_names", "canonical_names", "overrides")
    return resolve.resolve_names(raw, known, overrides, cascade)


@query
def resolve_first_source(spark, sf):
    return _resolved(spark, sf, resolve.FIRST_SOURCE)


@query
def resolve_second_source(spark, sf):
    return _resolved(spark, sf, resolve.SECOND_SOURCE)


@query
def resolve_rating_source(spark, sf):
    return _resolved(spark, sf, resolve.RATING_SOURCE)


@query
def resolve_source_pair(spark, sf):
    return _resolved(spark, sf, resolve.DIRECT_PAIR)


@query
def similar_name_pairs(spark, sf):
    raw, known = load(spark, sf, "raw_names", "canonical_names")
    return (
        similarity.similar_pairs(
            raw.select(F.col("raw").alias("word")), known.select(F.col("name").alias("candidate")), K.FUZZY_CUTOFF
        )
    )


@query
def closest_names(spark, sf):
    raw, known = load(spark, sf, "raw_names", "canonical_names")
    return (
        similarity.closest_names(
            raw.select(F.col("raw").alias("word")), known.select(F.col("name").alias("candidate")), K.FUZZY_CUTOFF
        )
    )


# ---- modelling on tables ----


@query
def result_targets(spark, sf):
    matches, *_ = load(spark, sf, "matches")
    with_over = matches.withColumn("Over", matchlevel.over_flag(F.col("home_goals"), F.col("away_goals")))
    return modelling.with_targets(with_over).select("match_id", "home_goals", "away_goals", "Over", "match_result")


@query
def season_split(spark, sf):
    (matches,) = load(spark, sf, "matches")
    return modelling.with_split(matches).groupBy("season", "split").agg(F.count(F.lit(1)).alias("n"))


def _model_table(spark, sf):
    matches, rows, _ = _long(spark, sf)
    feats = rolling.trailing_features(rows, windows=(K.HISTORY_WINDOW,), scopes=("ovr",), sums=False)
    return matchlevel.match_features(norm.base_matches(matches), feats)


@query
def min_history_filter(spark, sf):
    kept = modelling.min_history(_model_table(spark, sf))
    return kept.select("match_id", "ovr__games__r5__h", "ovr__games__r5__a")


@query
def model_matrix(spark, sf):
    table = modelling.with_targets(modelling.min_history(_model_table(spark, sf)))
    names = modelling.select_feature_columns(table.columns)
    return modelling.complete_rows(modelling.with_split(table), names).select("match_id", "split", "match_result", "Over", *names)


# ---- evaluation ----


def _judged(spark, sf):
    (p,) = load(spark, sf, "predictions")
    played = p.filter("home_goals is not null")
    with_over = played.withColumn("Over", matchlevel.over_flag(F.col("home_goals"), F.col("away_goals")))
    pick = evaluate.first_best_class([(c, F.col(f"p_{c.lower()}")) for c in K.RESULT_CLASSES])
    return modelling.with_targets(with_over).withColumn("result_pred", pick)


@query
def class_f1_scores(spark, sf):
    return evaluate.class_scores(_judged(spark, sf), "match_result", "result_pred")


@query
def result_metrics(spark, sf):
    return evaluate.result_metrics(_judged(spark, sf))


@query
def over_metrics(spark, sf):
    return evaluate.over_metrics(_judged(spark, sf))


@query
def prob_correlation(spark, sf):
    return evaluate.probability_correlation(_judged(spark, sf))


@query
def betting_result(spark, sf):
    return evaluate.betting_result(_judged(spark, sf))


@query
def betting_over(spark, sf):
    return evaluate.betting_over(_judged(spark, sf))


@query
def model_comparison(spark, sf):
    a = _judged(spark, sf)
    b = a.withColumn("p_over", F.col("p_over") * 0.5 + 0.25)
    return evaluate.comparison_report({"A": a, "B": b})


# ---- report ----


@query
def coming_matches(spark, sf):
    (matches,) = load(spark, sf, "matches")
    return report.coming_matches(matches, "1997-07-14").select("match_id", "date")


@query
def prediction_report(spark, sf):
    (p,) = load(spark, sf, "predictions")
    # Infinite odds are compared as a text: hashes of infinity differ between engines.
    out = report.prediction_report(p)
    return (
        out.withColumns(
            {c: F.when(quoted(c) == float("inf"), F.lit("inf")).otherwise(quoted(c).cast("decimal(20,2)").cast("string"))
             for c in ("Odds_Over_2.5", "Odds_Under_2.5")}
        )
    )


# ---- sinks and sources: written, and read back ----


def _folder(spark, name):
    """A new folder of the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/catalog/{name}-{uuid.uuid4().hex}"


@query
def match_tree_rewrite(spark, sf):
    """A tree of leagues and seasons, of which a second run replaces one season's folders."""
    (matches,) = load(spark, sf, "matches")
    path = _folder(spark, "tree")
    rows = matches.select("match_id", "league", "season", "home_goals", "away_goals")
    writers.write_match_tree(rows, path)
    newest = rows.filter(F.col("season").cast("string") == rows.agg(F.max(F.col("season").cast("string"))).scalar())
    writers.write_match_tree(newest.withColumn("home_goals", F.col("home_goals") + 1), path)
    back = readers.read_match_tree(spark, path, merge_schema=False)
    return back.select("match_id", F.col("league").cast("string"), F.col("season").cast("string"), "home_goals", "away_goals")


@query
def match_tree_scan(spark, sf):
    """Files with different columns in one tree: a season's rows, and how many folders were
    opened for them."""
    (matches,) = load(spark, sf, "matches")
    path = _folder(spark, "mixed")
    rows = matches.select("match_id", "league", "season", "home_goals", "home_xg")
    odd = F.substring("league", 8, 1).isin("1", "3", "5")
    writers.write_match_tree(rows.filter(odd).drop("home_xg"), path)
    writers.write_match_tree(rows.filter(odd.isNull() | ~odd), path)
    tree = readers.read_match_tree(spark, path)
    season = tree.select("*", F.col("_metadata.file_path").alias("_file")).filter(F.col("season").cast("string") == READ_SEASON)
    folder = F.regexp_extract("_file", "league=([^/]*)/", 1)
    return season.groupBy(F.col("season").cast("string").alias("season")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(folder).alias("folders"),
        F.count("home_xg").alias("with_xg"),
        F.sum("home_goals").alias("goals"),
    )


@query
def snapshot_rewrite(spark, sf):
    """Two dated snapshots; a rerun of the second date replaces that date only."""
    (snapshot_,) = load(spark, sf, "elo_snapshot")
    path = _folder(spark, "snapshots")
    table = snapshot_.select("team", "country", "elo")
    writers.write_snapshot(table, path, "2024-01-01")
    writers.write_snapshot(table, path, "2024-02-01")
    writers.write_snapshot(table.filter("country <> 'C2'").withColumn("elo", F.col("elo") + 5), path, "2024-02-01")
    return readers.read_table(spark, path).withColumn("as_of_date", F.col("as_of_date").cast("string"))


@query
def ordered_csv(spark, sf):
    """Place of each row of a sorted CSV sink, over all its files."""
    (matches,) = load(spark, sf, "matches")
    path = _folder(spark, "csv")
    writers.write_csv(matches.select("match_id", "home_team"), path, order=["home_team", "match_id"])
    return file_positions(readers.read_csv(spark, path, "match_id string, home_team string"))


@query
def name_map_round_trip(spark, sf):
    """A name map that grows with the customers, through its sink and source."""
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    path = _folder(spark, "names")
    raw = F.concat_ws(" ", F.upper("c_name"), F.lit('"quoted"'), F.col("c_mktsegment"))
    writers.write_name_map(customers.select(raw.alias("raw"), F.col("c_name").alias("canonical")), path)
    return readers.read_name_map(spark, path)


@query
def guarded_matches(spark, sf):
    """Rows behind a guard against an empty table, by season."""
    (matches,) = load(spark, sf, "matches")
    guarded = guard_rows(matches.select("season", "home_goals"), "no matches")
    return guarded.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"))


@query
def season_names(spark, sf):
    """The seasons that a batch load asks for, with the matches there are of each."""
    (matches,) = load(spark, sf, "matches")
    seasons = season_list(spark, AS_OF, first_year=1994)
    there = matches.groupBy(F.col("season").cast("int").alias("start_year")).agg(F.count(F.lit(1)).alias("n"))
    return seasons.join(there, "start_year", "left").select("start_year", "season", "folder", "short", F.coalesce("n", F.lit(0)).alias("n"))


# ---- whole jobs ----


def _training_base(spark, sf):
    raw, names, mh, ratings, rating_names = load(
        spark, sf, "raw_matches", "match_names", "match_history", "raw_ratings", "rating_names"
    )
    renamed = names.select("raw", F.col("canonical"))
    to_team = rating_names.join(renamed.select(F.col("raw").alias("canonical"), F.col("canonical").alias("t")), "canonical", "left")
    rating_map = to_team.select("raw", F.coalesce("t", "canonical").alias("canonical"))
    return feature_plan.build_base(raw, names, mh, names, ratings, rating_map)


@query
def training_base(spark, sf):
    return _training_base(spark, sf)


@query
def training_features(spark, sf):
    """The whole feature table: 738 trailing columns on the base."""
    return feature_plan.build_features(_training_base(spark, sf))


def _trained(spark, sf, variants):
    """The variants with the operator's own parameters, on all labelled rows."""
    matches, ratings, mh = load(spark, sf, "matches", "elo_history", "match_history")
    base = feature_plan.build_base(matches, match_history=mh, rating_history=ratings)
    table = feature_plan.build_features(base, windows=(K.HISTORY_WINDOW,), scopes=("ovr",))
    return table, train_and_compare(table, K.BOOSTING, variants=variants)


@query
def train_and_score(spark, sf):
    _, trained = _trained(spark, sf, ("A",))
    return trained.scored["A"].select("match_id", "match_result", "result_pred", "p_h", "p_d", "p_a", "p_over")


@query
def train_comparison(spark, sf):
    _, trained = _trained(spark, sf, ("A", "B"))
    return trained.report


@query
def predict_coming_matches(spark, sf):
    """Models saved, loaded again and used on the coming matches."""
    table, trained = _trained(spark, sf, ("A",))
    path = _folder(spark, "models")
    writers.write_model(trained.result_model, f"{path}/result")
    writers.write_model(trained.over_model, f"{path}/over")
    result_model, over_model = readers.read_model(f"{path}/result"), readers.read_model(f"{path}/over")
    return predict_coming(table, result_model, over_model, "1997-07-14")
