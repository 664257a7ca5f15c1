"""Metrics, back-test, split, training, scoring, report."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.catalog import queries
from duelframe.operators import evaluate, modelling, report
from duelframe.plans import train as train_plan
from duelframe.plans.predict import predict_coming
from duelframe.plans.train import train_and_compare
from duelframe.sources import readers, writers

NAN = float("nan")


def predictions(spark, rows):
    return spark.createDataFrame(
        rows,
        "match_result string, Over int, p_a double, p_d double, p_h double, p_over double, "
        "odds_a double, odds_d double, odds_h double, odds_over double, odds_under double",
    ).withColumn("result_pred", evaluate.first_best_class([(c, F.col(f"p_{c.lower()}")) for c in "ADH"]))


ROWS = [
    ("H", 1, 0.2, 0.2, 0.6, 0.7, 3.0, 3.0, 2.0, 1.5, 2.0),   # H at 2.0: ev 0.2, won 1.0; over 1.5: ev 0.05, won 0.5
    ("A", 0, 0.4, 0.2, 0.4, 0.5, 3.0, 3.0, 2.0, 9.0, 2.5),   # tie: A at 3.0: ev 0.2, won 2.0; 0.5 goes under 2.5: won 1.5
    ("D", 1, 0.1, 0.1, 0.8, 0.2, 3.0, 3.0, 1.2, 1.5, 1.3),   # H at 1.2: ev -0.04 none; under 1.3: ev 0.04, lost
    ("D", 0, 0.1, 0.6, 0.3, 0.9, 3.0, None, 1.2, NAN, 1.3),  # no odds: none; NaN odds: none
]


def test_result_back_test(spark):
    r = evaluate.betting_result(predictions(spark, ROWS)).first()
    assert (r["games"], r["bets"], r["total_profit"], r["avg_return"], r["bet_share"]) == (4, 2, 3.0, 1.5, 0.5)


def test_over_back_test(spark):
    r = evaluate.betting_over(predictions(spark, ROWS)).first()
    assert (r["games"], r["bets"], r["bet_share"]) == (4, 3, 0.75)
    assert r["total_profit"] == pytest.approx(1.0) and r["avg_return"] == pytest.approx(1 / 3)


def test_back_test_without_rows_or_odds(spark):
    empty = evaluate.betting_result(predictions(spark, ROWS).limit(0)).first()
    assert (empty["games"], empty["bets"], empty["total_profit"], empty["avg_return"], empty["bet_share"]) == (0, 0, 0.0, 0.0, 0.0)
    none = evaluate.betting_result(predictions(spark, ROWS).drop("odds_h")).first()
    assert none["games"] == 4 and none["bets"] is None and none["total_profit"] is None


def test_metrics(spark):
    df = predictions(spark, ROWS)
    m = evaluate.result_metrics(df).first()
    # picks H A H D against H A D D
    f1 = {"A": 1.0, "D": 2 / 3, "H": 2 / 3}
    assert m["accuracy"] == 0.75 and m["macro_f1"] == pytest.approx(sum(f1.values()) / 3)
    o = evaluate.over_metrics(df).first()
    assert o["accuracy"] == pytest.approx(0.25)  # 0.5 counts as over
    assert o["brier"] == pytest.approx((0.09 + 0.25 + 0.64 + 0.81) / 4)
    assert o["log_loss"] == pytest.approx(-sum(map(math.log, (0.7, 0.5, 0.2, 0.1))) / 4)


def test_constant_probability_has_no_correlation(spark):
    df = predictions(spark, [r[:4] + (0.6, 0.7) + r[6:] for r in ROWS])
    row = evaluate.probability_correlation(df).first()
    assert math.isnan(row["corr_h"]) and math.isnan(row["corr_over"])
    assert evaluate.probability_correlation(df.limit(0)).first()["corr_h"] is None


def test_log_loss_is_clipped(spark):
    sure = predictions(spark, [("H", 0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    assert evaluate.over_metrics(sure).first()["log_loss"] == pytest.approx(-math.log(evaluate.EPSILON))


def test_classes_seen_only_in_predictions_count(spark):
    df = spark.createDataFrame([("H", "H"), ("H", "A")], "match_result string, result_pred string")
    assert evaluate.result_metrics(df).first()["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)


def test_complete_rows_keep_nan_and_count(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,)], "x double")
    kept, seen = modelling.complete_rows_counted(df, ["x"], "complete")
    assert kept.count() == 2
    assert seen.get == {"rows": 3, "dropped": 1}


def seasons(spark, names):
    return spark.createDataFrame([(n,) for n in names], "season string")


def test_season_split(spark):
    df = modelling.with_split(seasons(spark, ["1415", "1516", "1617", "1718", "1718", None]))
    assert {r["season"]: r["split"] for r in df.collect()} == {
        "1415": "train", "1516": "train", "1617": "validation", "1718": "excluded", None: None,
    }
    with pytest.raises(ValueError, match="three seasons"):
        modelling.latest_seasons(seasons(spark, ["1415", "1516"]))
    with pytest.raises(Exception, match="three seasons"):
        modelling.with_split(seasons(spark, ["1415", "1516"])).collect()


def test_season_split_starts_no_job_before_its_action(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split", "split")
    try:
        df = modelling.with_split(seasons(spark, ["1415", "1516", "1617"]))
        assert not tracker.getJobIdsForGroup("split")
        assert df.count() == 3 and tracker.getJobIdsForGroup("split")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_feature_choice():
    columns = ["ovr__xg_for__r5__h", "ovr__xg_for__sum__r5__h", "ovr__games__r5__a", "home__gf__r5__h", "ovr__gf__r3__a", "elo_sum", "ovr__gf__r5__a"]
    assert modelling.select_feature_columns(columns) == ["elo_sum", "ovr__gf__r5__a", "ovr__xg_for__r5__h"]


def feature_table(spark, seasons_=4, per_season=60):
    rows = spark.range(seasons_ * per_season).withColumn("r", F.col("id") % 7)
    columns = [
        F.col("id").cast("string").alias("match_id"), F.lit("L 1").alias("league"),
        (F.lit(2014) + F.floor(F.col("id") / per_season)).cast("string").alias("season"),
        F.timestamp_add("HOUR", (F.col("id") * 5).cast("int"), F.lit(dt.datetime(2014, 8, 1))).cast("timestamp_ntz").alias("date"),
        F.concat(F.lit("t"), F.col("id") % 5).alias("home_team"), F.concat(F.lit("t"), (F.col("id") + 1) % 5).alias("away_team"),
        (F.col("r") % 4).cast("int").alias("home_goals"), (F.col("r") % 3).cast("int").alias("away_goals"),
        (F.col("r") % 4 + F.col("r") % 3 > 2.5).cast("tinyint").alias("Over"),
        F.lit(5).alias("ovr__games__r5__h"), F.when(F.col("id") % 11 > 0, 5).otherwise(4).alias("ovr__games__r5__a"),
        F.when(F.col("id") % 13 > 0, F.col("r") * 1.0).alias("ovr__gf__r5__h"), ((F.col("id") * 3) % 5 * 1.0).alias("ovr__ga__r5__a"),
        (F.col("r") - 3.0).alias("elo_diff"),
        (1.5 + F.col("id") % 5).alias("odds_h"), F.lit(3.0).alias("odds_d"), F.lit(3.5).alias("odds_a"),
        F.when(F.col("id") % 17 > 0, F.lit(1.9) + F.col("r") * 0.01).alias("odds_over"), F.lit(1.9).alias("odds_under"),
    ]
    return rows.select(*columns)


TREES = {"trees": 8, "depth": 3, "rate": 0.4, "min_rows": 5, "seed": 42}


@pytest.fixture(scope="module")
def trained(spark):
    return train_and_compare(feature_table(spark), TREES, source="somewhere")


def test_training_and_comparison(trained):
    assert (trained.seasons.current, trained.seasons.validation) == ("2017", "2016")
    rows = {(r["model"], r["target"], r["metric"]): r["value"] for r in trained.report.collect()}
    assert len(rows) == 20 and rows[("A", "result", "accuracy")] > 0.9
    scored = trained.scored["A"].collect()
    assert {r["season"] for r in scored} == {"2016"}
    assert all(abs(r["p_a"] + r["p_d"] + r["p_h"] - 1) < 1e-9 and 0 <= r["p_over"] <= 1 for r in scored)
    # Both variants are judged on the same matches.
    ids = {v: {r["match_id"] for r in df.collect()} for v, df in trained.scored.items()}
    assert ids["A"] == ids["B"]


def test_training_queries_fit_the_whole_job(spark, monkeypatch):
    class Fitting(Exception):
        pass

    def fit(train, specs, params):
        raise Fitting(train.count(), params, [(s.variant, s.target) for s in specs])

    table = feature_table(spark)
    monkeypatch.setattr(queries, "load", lambda *_: (None, None, None))
    monkeypatch.setattr(queries.feature_plan, "build_base", lambda *_, **__: None)
    monkeypatch.setattr(queries.feature_plan, "build_features", lambda *_, **__: table)
    monkeypatch.setattr(train_plan, "fit_models", fit)
    labelled = modelling.min_history(table).filter("season < '2016'").count()
    a, b = [("A", "result"), ("A", "over")], [("B", "result"), ("B", "over")]
    for name, models in (("train_and_score", a), ("train_comparison", a + b), ("predict_coming_matches", a)):
        with pytest.raises(Fitting) as seen:
            queries.PLAIN[name](spark, "")
        assert seen.value.args == (labelled, K.BOOSTING, models)


def test_saved_models_predict_the_same(spark, trained, tmp_path):
    writers.write_model(trained.result_model, f"{tmp_path}/r")
    writers.write_model(trained.over_model, f"{tmp_path}/o")
    writers.write_metadata(trained.metadata, f"{tmp_path}/meta")
    meta = readers.read_metadata(spark, f"{tmp_path}/meta").first()
    assert meta["validation_season"] == "2016" and meta["train_seasons"] == ["2014", "2015"] and meta["parquet"] == "somewhere"
    assert "A_result_accuracy" in meta["comparison"].asDict() and meta["feature_cols"] == trained.features
    table = feature_table(spark)
    a = predict_coming(table, trained.result_model, trained.over_model, "2014-08-10")
    b = predict_coming(table, readers.read_model(f"{tmp_path}/r"), readers.read_model(f"{tmp_path}/o"), "2014-08-10")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.columns == K.REPORT_COLUMNS and 0 < a.count() < 24
    strict = predict_coming(table, trained.result_model, trained.over_model, "2014-08-10", history_filter=True)
    assert strict.count() < a.count()


def test_scoring_needs_the_features(spark, trained):
    with pytest.raises(ValueError, match="ovr__gf__r5__h"):
        predict_coming(feature_table(spark).drop("ovr__gf__r5__h"), trained.result_model, trained.over_model, "2014-08-10")


def test_report(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 23, 15), "L", "a", "b", 0.3, 0.3, 0.4, 0.0, 1.5), (dt.datetime(2024, 7, 1, 20), "L", "c", "d", 0.4, 0.2, 0.4, 0.5, None)],
        "date timestamp_ntz, league string, home_team string, away_team string, p_a double, p_d double, p_h double, p_over double, odds_h double",
    )
    out = report.prediction_report(df)
    assert "Bookie_D" not in out.columns and out.columns[:6] == K.REPORT_COLUMNS[:6]
    first, second = out.orderBy("home_team").collect()
    assert (first["Day"], first["Time"], second["Time"]) == ("2024-01-02", "01:15", "23:00")  # winter +2, summer +3
    assert (first["Result_Pred"], second["Result_Pred"]) == ("H", "A")
    assert first["Odds_Over_2.5"] == float("inf") and first["Odds_Under_2.5"] == 1.0 and second["Over_Under_Pred"] == "Over"
    assert (first["Prob_A"], first["Odds_A"], first["Bookie_H"]) == (0.3, 3.33, 1.5)


def test_date_window_is_half_open_and_reaches_the_scan(spark, tmp_path):
    days = spark.range(10).select(F.timestamp_add("DAY", F.col("id").cast("int"), F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz").alias("date"))
    days.write.parquet(f"{tmp_path}/days")
    out = report.coming_matches(spark.read.parquet(f"{tmp_path}/days"), "2024-01-03")
    assert sorted(r["date"].day for r in out.collect()) == [3, 4, 5, 6]
    pushed = out._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed
