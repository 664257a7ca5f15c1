"""Command line: `python -m duelframe.jobs <job> --option value ...`.

Every "now" is the `--as-of` argument, so that a job can be run again for the same day.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.dates import season_list
from duelframe.operators.checks import guard_rows
from duelframe.plans import features as feature_plan
from duelframe.plans import names as name_plan
from duelframe.plans import ratings as rating_plan
from duelframe.plans.predict import predict_coming_counted
from duelframe.plans.train import train_and_compare
from duelframe.session import build_session
from duelframe.sources import readers, writers


def land_matches(spark: SparkSession, args) -> None:
    """Landed per-season files into the league/season tree."""
    from duelframe.operators.normalize import normalise_landed

    writers.write_match_tree(normalise_landed(readers.read_match_tree(spark, args.input)), args.output)


def land_odds(spark: SparkSession, args) -> None:
    """Landed odds files of the seasons up to `--as-of` into one table."""
    seasons = season_list(spark, args.as_of).select(F.col("short").alias("season"))
    landed = readers.read_match_tree(spark, args.input).withColumn("season", F.col("season").cast("string"))
    known = guard_rows(landed.join(seasons, "season", "left_semi"), f"no odds of a season up to {args.as_of}")
    writers.write_table(known, args.output)


def rating_tables(spark: SparkSession, args) -> None:
    """Landed snapshots and histories to the team universe and the interval history."""
    universe = rating_plan.rating_universe([readers.read_match_tree(spark, args.snapshots)])
    writers.write_table(universe, args.universe)
    history = rating_plan.rating_history(
        [readers.read_match_tree(spark, args.input)], readers.read_table(spark, args.universe), args.as_of
    )
    writers.write_table(history, args.output)


def rating_snapshot(spark: SparkSession, args) -> None:
    """One dated rating table to snapshot, roster and (optional) selected histories."""
    tables = rating_plan.current_ratings(
        readers.read_table(spark, args.input), args.as_of,
        histories=readers.read_optional(spark, args.rating_history),
    )
    for name, table in tables.items():
        writers.write_snapshot(table.drop("as_of_date"), f"{args.output}/{name}", args.as_of)


def name_maps(spark: SparkSession, args) -> None:
    """The three name maps from raw matches, raw odds and the team universe."""
    overrides = readers.read_name_map(spark, args.overrides)
    match_map = name_plan.map_match_names(readers.read_match_tree(spark, args.input), overrides)
    odds_map = name_plan.map_odds_names(readers.read_table(spark, args.match_history), match_map, overrides)
    rating_overrides = readers.read_name_map(spark, args.rating_overrides or args.overrides)
    rating_map = name_plan.map_rating_names(readers.read_table(spark, args.universe), match_map, rating_overrides)
    for name, resolved in (("matches", match_map), ("odds", odds_map), ("ratings", rating_map)):
        writers.write_name_map(name_plan.as_name_map(resolved), f"{args.output}/{name}")
    left = rating_map.filter(F.col("canonical").isNull()).select("raw", "method")
    writers.write_csv(left, f"{args.output}/ratings_unmatched", order=["raw"])


def _base(spark: SparkSession, args, matches, current=None):
    return feature_plan.build_base(
        matches,
        name_map=readers.read_optional_name_map(spark, args.match_names),
        match_history=readers.read_optional(spark, args.match_history),
        odds_name_map=readers.read_optional_name_map(spark, args.odds_names),
        rating_history=readers.read_optional(spark, args.rating_history),
        rating_name_map=readers.read_optional_name_map(spark, args.rating_names),
        current_ratings=current,
    )


def training_features(spark: SparkSession, args) -> None:
    base = _base(spark, args, readers.read_match_tree(spark, args.input))
    writers.write_features(feature_plan.build_features(base, pieces=args.pieces), args.output)


def current_features(spark: SparkSession, args) -> None:
    """Played matches and schedule of the running season to its feature table."""
    landed = feature_plan.combine_landed(
        [readers.read_match_tree(spark, args.input)], [readers.read_match_tree(spark, args.schedule)]
    )
    current = readers.read_optional(spark, args.current_ratings)
    if current is not None and "as_of_date" in current.columns:
        current = current.filter(F.col("as_of_date").cast("string") == args.as_of)
    base = _base(spark, args, landed, current)
    writers.write_features(feature_plan.build_features(base, pieces=args.pieces), args.output)


def train(spark: SparkSession, args) -> None:
    trained = train_and_compare(readers.read_table(spark, args.input), source=args.input)
    writers.write_model(trained.result_model, f"{args.output}/result_model")
    writers.write_model(trained.over_model, f"{args.output}/over_model")
    writers.write_metadata(trained.metadata, f"{args.output}/metadata")
    order = ["model", "target", "metric"]
    writers.write_csv(trained.report.unionByName(trained.quality).distinct(), f"{args.output}/evaluation", order=order)


def predict(spark: SparkSession, args) -> None:
    report, counts = predict_coming_counted(
        readers.read_table(spark, args.input),
        readers.read_model(f"{args.models}/result_model"),
        readers.read_model(f"{args.models}/over_model"),
        args.as_of,
    )
    writers.write_csv(report, args.output)
    rows, dropped = counts.get["rows"], counts.get["dropped"]
    print(f"coming matches: {rows}, dropped for missing features: {dropped}")
    if not rows:
        print(f"no match in the {K.REPORT_DAYS} days from {args.as_of}: the report is empty")
    elif rows == dropped:
        print("no coming match has all features: the report is empty")


JOBS = {
    "land-matches": land_matches,
    "land-odds": land_odds,
    "rating-tables": rating_tables,
    "rating-snapshot": rating_snapshot,
    "name-maps": name_maps,
    "training-features": training_features,
    "current-features": current_features,
    "train": train,
    "predict": predict,
}

CONSTRAINTS = "spark.sql.constraintPropagation.enabled"

OPTIONS = [
    "input", "output", "as-of", "schedule", "snapshots", "universe", "overrides", "rating-overrides",
    "match-history", "match-names", "odds-names", "rating-names", "rating-history", "current-ratings", "models",
]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="duelframe")
    parser.add_argument("job", choices=sorted(JOBS))
    for option in OPTIONS:
        parser.add_argument(f"--{option}", required=option in ("input", "output"))
    parser.add_argument("--pieces", type=int, help="cut the teams' sequences into so many tasks, for teams too long for one")
    args = parser.parse_args(argv)
    spark = build_session(f"duelframe {args.job}")
    # Planning would hold each of some thousand feature expressions against all others.
    before = spark.conf.get(CONSTRAINTS)
    spark.conf.set(CONSTRAINTS, "false")
    try:
        JOBS[args.job](spark, args)
    finally:
        spark.conf.set(CONSTRAINTS, before)


if __name__ == "__main__":
    main()
