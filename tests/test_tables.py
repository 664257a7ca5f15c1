"""Normalise, ingest, odds, histories, snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions import dates, outcomes, text
from duelframe.operators import history, ingest, normalize, odds, snapshot
from duelframe.operators.checks import require_columns, require_rows, require_unique
from duelframe.plans.ratings import current_ratings, rating_history, rating_universe

D = dt.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("2017-08-18 19:30:00", D(2017, 8, 18, 19, 30)),
        ("2017-08-18", D(2017, 8, 18)),
        ("2017-08-18T19:30:00", D(2017, 8, 18, 19, 30)),
        ("18.08.2017", None),
        ("n/a", None),
        (None, None),
    ],
)
def test_lenient_dates(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "date string")
    assert normalize.with_parsed_date(df).first()["date"] == wanted


def test_date_is_widened_and_timestamp_stays(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 2),)], "date date")
    assert normalize.with_parsed_date(df).first()["date"] == D(2020, 1, 2)
    stays = spark.createDataFrame([(D(2020, 1, 2, 3),)], "date timestamp_ntz")
    assert normalize.with_parsed_date(stays).first()["date"] == D(2020, 1, 2, 3)


def test_aliases_and_types(spark):
    df = spark.createDataFrame([(7, "a", "3", 1)], "match_id int, team_h string, h_goals string, other int")
    out = normalize.normalise_matches(df)
    assert out.dtypes == [("match_id", "string"), ("home_team", "string"), ("home_goals", "int"), ("other", "int")]


def test_clashing_aliases_are_refused(spark):
    with pytest.raises(ValueError, match="home_deep"):
        normalize.normalise_matches(spark.createDataFrame([(1, 2)], "h_deep int, home_deep int"))
    with pytest.raises(ValueError):
        normalize.lower_case_columns(spark.createDataFrame([(1, 2)], "A int, b int").toDF("A", "a"))


def test_bad_number_fails(spark):
    df = normalize.normalise_matches(spark.createDataFrame([("x",)], "home_goals string"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.collect()


def test_lenient_numbers(spark):
    assert one(spark, dates.lenient_number(F.lit("12.5"))) == 12.5
    assert one(spark, dates.lenient_number(F.lit("None"))) is None


@pytest.mark.parametrize("day, full, short", [("2024-06-30", "2023/2024", "23-24"), ("2024-07-01", "2024/2025", "24-25"), ("1999-08-01", "1999/2000", "99-00")])
def test_seasons(spark, day, full, short):
    start = dates.season_start_year(F.lit(day).cast("date"))
    assert one(spark, dates.season_label(start)) == full
    assert one(spark, dates.short_season_label(start)) == short


def test_season_list_and_compact_label(spark):
    rows = dates.season_list(spark, "2016-03-01").collect()
    assert [tuple(r) for r in rows] == [(2014, "2014/2015", "2014-2015", "14-15"), (2015, "2015/2016", "2015-2016", "15-16")]
    assert one(spark, dates.compact_season(F.lit("14-15-x"))) == "1415-x"


def test_snapshot_dates(spark):
    days = one(spark, dates.snapshot_dates(F.lit("2014-01-01"), F.lit("2014-08-29")))
    assert days == [dt.date(2014, 1, 1), dt.date(2014, 5, 1), dt.date(2014, 8, 29)]
    assert one(spark, dates.snapshot_dates(F.lit("2014-01-02"), F.lit("2014-01-01"))) == []


def test_names(spark):
    assert one(spark, text.normalised_name(F.lit(" \tM'Gladbach-F.C. 04 "))) == "m'gladbachfc04"
    assert one(spark, text.normalised_name(F.lit(None).cast("string"))) == ""
    assert one(spark, text.path_key(F.lit("ENG-Premier League"))) == "ENG-Premier_League"


def test_outcome_rules(spark):
    null = F.lit(None).cast("int")
    assert one(spark, outcomes.result_label(null, null)) == "D"
    assert one(spark, outcomes.over_flag(null, F.lit(3))) is None
    assert one(spark, outcomes.over_flag(F.lit(1), F.lit(2))) == 1 and one(spark, outcomes.over_flag(F.lit(1), F.lit(1))) == 0
    assert one(spark, outcomes.over_under_label(F.lit(0.5))) == "Over"
    assert one(spark, outcomes.first_best_class([("A", F.lit(0.4)), ("D", F.lit(0.2)), ("H", F.lit(0.4))])) == "A"
    assert one(spark, outcomes.fair_odds(F.lit(0.0))) == float("inf")
    assert one(spark, outcomes.rounded(F.lit(0.0625), 3)) == 0.062  # half to even


def test_richest_row_wins_and_ties_prefer(spark):
    df = spark.createDataFrame(
        [("L", "1", 5, None, False), ("L", "1", 5, 9, False), ("L", "2", 1, None, True), ("L", "2", None, 7, False), (None, "3", 1, 1, True), (None, "3", 1, None, True)],
        "league string, match_id string, a int, b int, stats boolean",
    )
    rows = ingest.richest_rows(df, ["league", "match_id"], prefer=[F.col("stats")]).orderBy("match_id").collect()
    assert [tuple(r) for r in rows] == [("L", "1", 5, 9, False), ("L", "2", 1, None, True), (None, "3", 1, 1, True)]


def test_richest_row_combines_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("L").alias("league"), F.lit("1").alias("match_id"), F.col("id").alias("a"))
    plan = ingest.richest_rows(df, ["league", "match_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") > plan.index("Exchange")


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert {tuple(r) for r in ingest.union_all([a, b]).collect()} == {(1, 2), (3, None)}
    with pytest.raises(ValueError):
        ingest.union_all([])


def odds_table(spark, rows):
    return spark.createDataFrame(
        rows, "season string, home_team string, away_team string, HS double, B365H double, B365CH double, `B365>2.5` double"
    )


def test_odds_precedence_and_missing_columns(spark):
    table = odds.prepare_odds(odds_table(spark, [("14-15", "a", "b", 9.0, 1.5, None, 2.0), ("14-15", "c", "d", 9.0, 1.5, 1.7, None)]))
    rows = {r["home_team"]: r for r in table.collect()}
    assert rows["a"]["season"] == "1415" and rows["a"]["odds_h"] == 1.5 and rows["c"]["odds_h"] == 1.7
    assert rows["a"]["odds_over"] == 2.0 and rows["a"]["odds_under"] is None
    assert dict(table.dtypes)["odds_d"] == "double"


def test_odds_join_keeps_rows_and_replaces_shots(spark):
    matches = spark.createDataFrame([(1, 1415, "a", "b", 1.0), (2, 1415, "x", "y", 2.0), (3, 1415, None, "b", 3.0)], "id int, season int, home_team string, away_team string, home_shots double")
    joined = odds.attach_odds(matches, odds.prepare_odds(odds_table(spark, [("14-15", "a", "b", 9.0, 1.5, None, 2.0)])))
    rows = {r["id"]: r for r in joined.collect()}
    assert rows[1]["home_shots"] == 9.0 and rows[2]["home_shots"] is None and rows[3]["odds_h"] is None and len(rows) == 3
    assert odds.attach_odds(matches, None) is matches


def test_repeated_odds_key_is_refused(spark):
    matches = spark.createDataFrame([("1415", "a", "b")], "season string, home_team string, away_team string")
    table = odds.prepare_odds(odds_table(spark, [("14-15", "a", "b", 9.0, 1.5, None, 2.0)] * 2))
    with pytest.raises(Exception, match="not unique"):
        odds.attach_odds(matches, table).collect()
    assert odds.attach_odds(matches, table, check_unique=False).count() == 2


def test_hot_join_key_is_split_at_run_time(spark):
    """A third of the rows on one key: adaptive execution splits it, no row is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        matches = spark.range(0, 120000, 1, 8).select(
            F.lit("1415").alias("season"), F.concat(F.lit("n"), F.uuid()).alias("note"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("home_team"), F.lit("b").alias("away_team"),
        )
        table = spark.range(500).select(F.lit("1415").alias("season"), F.concat(F.lit("t"), F.col("id")).alias("home_team"), F.lit("b").alias("away_team"), F.lit(1.5).alias("odds_h"))
        hot = spark.createDataFrame([("1415", "hot", "b", 2.5)], table.schema)
        joined = odds.attach_odds(matches, table.unionByName(hot), check_unique=False)
        rows = joined.groupBy("odds_h").count().collect()
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["odds_h"]: r["count"] for r in rows} == {1.5: 80000, 2.5: 40000}
    assert "skew=true" in plan


def test_interval_end(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 11), 2.0), ("a", None, 3.0), ("b", D(2020, 1, 5), 4.0)],
        "team string, valid_from timestamp_ntz, elo double",
    )
    for limit in (None, 1):
        out = history.with_interval_end(df, F.lit(D(2021, 1, 1)).cast("timestamp_ntz"), pieces=limit)
        got = {r["elo"]: r["valid_to"] for r in out.collect()}
        assert got == {1.0: D(2020, 1, 10), 2.0: D(2021, 1, 1), 3.0: D(2021, 1, 1), 4.0: D(2021, 1, 1)}


def test_universe_takes_the_first_snapshot(spark):
    a = spark.createDataFrame([("x", "ENG", D(2015, 1, 1)), ("y", None, D(2015, 1, 1)), ("z", "BRA", D(2015, 1, 1))], "team string, country string, snapshot_date timestamp_ntz")
    b = spark.createDataFrame([("x", "ESP", D(2014, 1, 1)), ("y", "GER", D(2016, 1, 1))], "team string, country string, snapshot_date timestamp_ntz")
    assert {tuple(r) for r in history.team_universe(ingest.union_all([a, b])).collect()} == {("x", "ESP"), ("y", None), ("z", "BRA")}
    assert {tuple(r) for r in rating_universe([a, b]).collect()} == {("x", "ESP"), ("y", "GER")}


def test_history_job(spark):
    raw = spark.createDataFrame(
        [("x", "2013-01-01", "1400"), ("x", "2013-06-01", "1450"), ("x", "2015-01-01", "1500"), ("x", "bad", "bad")],
        "team string, to string, elo string",
    )
    universe = spark.createDataFrame([("x", "ENG")], "team string, country string")
    rows = rating_history([raw], universe, "2020-01-01").orderBy("valid_from").collect()
    assert rating_history([raw], universe, "2020-01-01").columns == ["team", "country", "valid_from", "valid_to", "elo"]
    assert [(r["country"], r["valid_from"], r["valid_to"], r["elo"]) for r in rows] == [
        ("ENG", None, D(2020, 1, 1), None),
        ("ENG", D(2013, 6, 1), D(2014, 12, 31), 1450.0),
        ("ENG", D(2015, 1, 1), D(2020, 1, 1), 1500.0),
    ]


def snapshot_rows(spark, rows, columns="team string, country string, rank string, elo string, level int"):
    return spark.createDataFrame(rows, columns)


def test_top_teams_by_rank_rating_or_name(spark):
    table = snapshot_rows(
        spark,
        [
            ("a1", "A", "2", "10", None), ("a2", "A", None, "99", None), ("a3", "A", "1", None, None),
            ("b1", "B", None, "5", None), ("b2", "B", "x", "7", None), ("c2", "C", None, None, None), ("c1", "C", None, None, None),
            ("d1", "D", "1", "1", None),
        ],
    )
    picked = {r["team"] for r in snapshot.top_division(table, ["A", "B", "C"], {"A": 2, "B": 1, "C": 1}).collect()}
    assert picked == {"a3", "a1", "b2", "c1"}


def test_level_one_if_any_level_is_known(spark):
    table = snapshot_rows(spark, [("a", "A", "1", "9", 1), ("b", "A", "2", "8", 2), ("c", "B", "3", "7", None)])
    assert {r["team"] for r in snapshot.top_division(table, ["A", "B"]).collect()} == {"a"}
    # Outside the listed countries a level does not count.
    assert {r["team"] for r in snapshot.top_division(table, ["B"]).collect()} == {"c"}


def test_optional_columns(spark):
    table = spark.createDataFrame([("b", "A"), ("a", "A")], "team string, country string")
    assert [r["team"] for r in snapshot.top_division(table, ["A"], {"A": 1}).collect()] == ["a"]


def test_snapshot_tables(spark):
    table = snapshot_rows(spark, [("a", "ENG", "1", "9", None), ("b", "XXX", "2", "8", None)])
    hist = spark.createDataFrame([("a", D(2020, 1, 1), None, 1.0), ("q", D(2020, 1, 1), None, 1.0)], "team string, valid_from timestamp_ntz, valid_to timestamp_ntz, elo double")
    out = current_ratings(table, "2024-05-01", histories=hist)
    assert out["asof"].first().asDict() == {"team_clubelo": "a", "country": "ENG", "rank": 1.0, "elo": 9.0, "as_of_date": "2024-05-01"}
    assert out["roster"].first()["group_label"] == "ENG-Top"
    assert [r["team_clubelo"] for r in out["histories"].collect()] == ["a"]
    with pytest.raises(ValueError, match="no rows"):
        current_ratings(table, "2024-05-01", countries=["ZZZ"])


def test_guards(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, ["c"], "x")
    with pytest.raises(ValueError, match="empty"):
        require_rows(df.filter("a > 5"), "empty")
    assert require_unique(df, ["b"], "x") is df  # a null key never joins
    with pytest.raises(ValueError, match="not unique"):
        require_unique(df, ["a"], "x")


def test_base_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "extra int, home_team int, match_id int")
    assert normalize.base_matches(df).columns == ["match_id", "home_team"]
    assert len(K.BASE_COLUMNS) == 31
