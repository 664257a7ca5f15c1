import pytest

from duelframe.operators import mapping
from duelframe.operators.resolve import DIRECT_PAIR, FIRST_SOURCE, RATING_SOURCE, SECOND_SOURCE, as_name_map, resolve_names
from duelframe.plans import names as plan


@pytest.fixture
def tables(spark):
    raw = ["Real Madrid", "REAL-MADRID.", "Ath Madrid", "Spurs", "Ghost", "zzz", None, "Real Madrid"]
    canonical = ["Real Madrid", "Atletico Madrid", "Tottenham", "R.e.a.l Madrid"]
    overrides = [("Spurs", "Tottenham"), ("Ghost", "Nowhere United")]
    return (
        spark.createDataFrame([(r,) for r in raw], "raw string"),
        spark.createDataFrame([(c,) for c in canonical], "name string"),
        spark.createDataFrame(overrides, "raw string, canonical string"),
    )


def run(tables, cascade):
    return {r["raw"]: (r["canonical"], r["method"]) for r in resolve_names(*tables, cascade).collect()}


def test_second_source(tables):
    assert run(tables, SECOND_SOURCE) == {
        "Real Madrid": ("Real Madrid", "exact"),
        "REAL-MADRID.": ("R.e.a.l Madrid", "normalised"),  # two names of one key: the smaller
        "Ath Madrid": ("Atletico Madrid", "fuzzy"),
        "Spurs": ("Tottenham", "override"),
        "Ghost": ("Nowhere United", "override"),
        "zzz": ("zzz", "identity"),
    }


def test_first_source(tables):
    got = run(tables, FIRST_SOURCE)
    assert got["Spurs"] == ("Tottenham", "override") and got["Ath Madrid"] == ("Ath Madrid", "identity")


def test_rating_source(tables):
    got = run(tables, RATING_SOURCE)
    assert got["Real Madrid"][1] == "exact" and got["Spurs"] == ("Tottenham", "override")
    assert got["Ghost"] == (None, "override_target_missing")
    assert got["Ath Madrid"] == (None, "unmatched")  # 0.72 is below the strict cut-off


def test_direct_pair(tables):
    got = run(tables, DIRECT_PAIR)
    assert got["Ghost"] == (None, "unmatched") and got["Ath Madrid"] == ("Atletico Madrid", "fuzzy")
    assert got["zzz"] == (None, "unmatched")


def test_name_map_is_unique_and_without_nulls(tables):
    rows = as_name_map(resolve_names(*tables, DIRECT_PAIR)).collect()
    assert len({r["raw"] for r in rows}) == len(rows) == 4


def test_replace_keeps_unknown_and_nulls(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None)], "home string, away string")
    m = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "N")], "raw string, canonical string")
    assert [tuple(r) for r in mapping.replace_names(df, m, ["home", "away"]).orderBy("home").collect()] == [("A", "B"), ("c", None)]


def test_canonical_only_drops_unmapped(spark):
    df = spark.createDataFrame([("a", 1), ("x", 2)], "team string, v int")
    m = spark.createDataFrame([("a", "A")], "raw string, canonical string")
    assert [tuple(r) for r in mapping.canonical_only(df, m, "team").collect()] == [("A", 1)]


def test_maps_of_three_sources(spark):
    matches = spark.createDataFrame([("Milan", "Parma Calcio 1913"), ("Roma", "Milan")], "home_team string, away_team string")
    odds = spark.createDataFrame([("milan", "Parma"), ("roma", "Unknown")], "home_team string, away_team string")
    universe = spark.createDataFrame([("Milan",), ("Rom",), ("Inter",)], "team string")
    overrides = spark.createDataFrame([("Milan", "AC Milan"), ("milan", "AC Milan"), ("Parma Calcio 1913", "Parma")], "raw string, canonical string")
    match_map = plan.map_match_names(matches, overrides)
    as_dict = lambda df: {r["raw"]: r["canonical"] for r in df.collect()}
    assert as_dict(match_map) == {"Milan": "AC Milan", "Roma": "Roma", "Parma Calcio 1913": "Parma"}
    assert as_dict(plan.map_odds_names(odds, match_map, overrides)) == {
        "milan": "AC Milan", "Parma": "Parma", "roma": "Roma", "Unknown": "Unknown",
    }
    assert as_dict(plan.map_rating_names(universe, match_map, overrides)) == {"Milan": "AC Milan", "Rom": "Roma", "Inter": None}
    targets = mapping.distinct_names(matches)
    assert as_dict(plan.map_source_pair(mapping.distinct_names(odds), targets, overrides))["Unknown"] is None
