"""Shapes of the physical plans."""

import pytest

from duelframe.catalog.fixtures import load
from duelframe.catalog.queries import QUERIES
from duelframe.operators import rolling

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_windows_share_one_shuffle_and_one_sort(spark):
    (matches,) = load(spark, SMALL, "matches")
    text = plan(rolling.trailing_features(rolling.team_rows(matches)))
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1
    assert text.count("FileScan") == 1 and "Python" not in text


def test_only_wanted_columns_are_read(spark):
    (matches,) = load(spark, SMALL, "matches")
    df = rolling.trailing_features(rolling.team_rows(matches), windows=(5,), stats=[], scopes=("ovr",))
    text = plan(df.select("match_id", "ovr__games__r5"))
    assert "ppda" not in text and "xg" not in text and "o_orderstatus" in text


def test_both_sides_share_the_rating_table(spark):
    df = QUERIES["asof_rating_both_sides"](spark, SMALL)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_ratings_come_back_by_team_and_day(spark):
    """No task holds all matches of a team: both sides of the join are dealt by both keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["asof_rating_both_sides"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for side in ("home", "away"):
        dealt = [x for x in text.split("\n") if "Exchange hashpartitioning(" in x and f"{side}_team" in x]
        assert dealt and all("_day" in x for x in dealt), side


@pytest.mark.parametrize(
    "name", [n for n in QUERIES if n.startswith(("resolve", "similar", "closest", "asof", "odds", "rating", "top"))]
)
def test_no_pairing_of_everything(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_python_only_for_the_name_ratio(spark):
    for name, query in QUERIES.items():
        if name.startswith(("train", "predict", "rolling_large", "interval_large", "model_matrix")):
            continue
        has_python = "ArrowEvalPython" in plan(query(spark, SMALL))
        assert has_python == name.startswith(("similar", "closest", "resolve_second", "resolve_rating", "resolve_source")), name


def test_top_teams_are_cut_before_the_shuffle(spark):
    text = plan(QUERIES["top_n_per_country"](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text
