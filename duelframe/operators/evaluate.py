"""Classification metrics, odds correlation and the betting back-test.

Every figure is an aggregate with a partial step before the shuffle; what is shuffled is
one row per task, or per task and class pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.columns import quoted
from duelframe.functions.outcomes import first_best_class, implied_probabilities
from duelframe.operators.modelling import odds_coverage

# Smallest probability a log loss is taken of: the step between 1 and the next double.
EPSILON = 2.220446049250313e-16


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: true positives, rows of the class, rows predicted so, F1."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(none)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), hit.alias("tp"), F.col("n").alias("actual"), none.alias("predicted")),
                F.struct(F.col("p").alias("label"), none.alias("tp"), none.alias("actual"), F.col("n").alias("predicted")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    return sums.withColumn("f1", 2 * F.col("tp") / (F.col("actual") + F.col("predicted")))


def result_metrics(df: DataFrame, truth: str = "match_result", predicted: str = "result_pred") -> DataFrame:
    """One row: accuracy and macro F1 over the classes seen in truth or prediction."""
    return class_scores(df, truth, predicted).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def _log_loss(truth: Column, p: Column) -> Column:
    of_truth = F.when(truth == 1, p).otherwise(1 - p)
    clipped = F.greatest(F.least(of_truth, F.lit(1 - EPSILON)), F.lit(EPSILON))
    return -F.avg(F.ln(clipped))


def over_metrics(df: DataFrame, truth: str = "Over", p: str = "p_over") -> DataFrame:
    """One row: accuracy (0.5 counts as Over), Brier score, log loss."""
    y, prob = F.col(truth), F.col(p)
    return df.agg(
        F.avg(((prob >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg((prob - y) * (prob - y)).alias("brier"),
        _log_loss(y, prob).alias("log_loss"),
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both values; NaN if one of them is constant
    (where `corr` would divide by zero and fail)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / F.when(spread != 0, spread))


def probability_correlation(df: DataFrame) -> DataFrame:
    """One row: model against implied probability, home win and Over."""
    implied_h = implied_probabilities([F.col(c) for c in K.RESULT_ODDS])[0]
    implied_over = implied_probabilities([F.col(c) for c in K.OVER_ODDS])[0]
    return df.agg(
        correlation(F.col("p_h"), implied_h).alias("corr_h"),
        correlation(F.col("p_over"), implied_over).alias("corr_over"),
    )


def _bet_columns(pick: Column, p: Column, odds: Column, truth: Column) -> dict[str, Column]:
    ev = p * odds - 1
    # NaN sorts above every number, but is no gain.
    bet = F.coalesce((ev > 0) & ~F.isnan(ev), F.lit(False))
    won = F.coalesce(truth == pick, F.lit(False))
    return {
        "pick": pick,
        "pick_odds": odds,
        "ev": ev,
        "bet": bet,
        "profit": F.when(bet, F.when(won, odds - 1).otherwise(F.lit(-1.0))),
    }


def with_result_bets(df: DataFrame, truth: str = "match_result") -> DataFrame:
    """One unit on the likeliest result if its expected value is positive."""
    probabilities = [(c, F.col(f"p_{c.lower()}")) for c in K.RESULT_CLASSES]
    pick = first_best_class(probabilities)
    odds = reduce(
        lambda otherwise, c: F.when(pick == c, F.col(f"odds_{c.lower()}")).otherwise(otherwise),
        reversed(K.RESULT_CLASSES),
        F.lit(None).cast("double"),
    )
    best = F.greatest(*[p for _, p in probabilities])
    return df.withColumns(_bet_columns(pick, best, odds, F.col(truth)))


def with_over_bets(df: DataFrame, truth: str = "Over") -> DataFrame:
    """The same on Over/Under; an even chance goes to Under."""
    over, under = F.col("p_over"), 1 - F.col("p_over")
    is_over = over > under
    return df.withColumns(
        _bet_columns(
            is_over.cast("int"),
            F.when(is_over, over).otherwise(under),
            F.when(is_over, F.col("odds_over")).otherwise(F.col("odds_under")),
            F.col(truth),
        )
    )


def _betting(games: Column, bet: Column, profit: Column) -> dict[str, Column]:
    bets = F.count_if(bet)
    total = F.coalesce(F.sum(profit), F.lit(0.0))
    return {
        "games": games,
        "bets": bets,
        "total_profit": total,
        "avg_return": F.when(bets > 0, total / bets).otherwise(F.lit(0.0)),
        "bet_share": F.when(games > 0, bets / games).otherwise(F.lit(0.0)),
    }


def betting_summary(df: DataFrame) -> DataFrame:
    """One row over rows with bet columns. Return is per bet, share per game."""
    figures = _betting(F.count(F.lit(1)), F.col("bet"), F.col("profit"))
    return df.agg(*[c.alias(n) for n, c in figures.items()])


def _no_betting(df: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("games"),
        F.max(F.lit(None).cast("bigint")).alias("bets"),
        *[F.max(empty).alias(n) for n in ("total_profit", "avg_return", "bet_share")],
    )


def betting_result(df: DataFrame) -> DataFrame:
    """Back-test of the result bets; without odds columns the figures are null."""
    if not set(K.RESULT_ODDS) <= set(df.columns):
        return _no_betting(df)
    return betting_summary(with_result_bets(df))


def betting_over(df: DataFrame) -> DataFrame:
    """Back-test of the Over/Under bets; without odds columns the figures are null."""
    if not set(K.OVER_ODDS) <= set(df.columns):
        return _no_betting(df)
    return betting_summary(with_over_bets(df))


def comparison_report(scored: dict[str, DataFrame]) -> DataFrame:
    """`(model, target, metric, value)` for each scored frame: accuracy, correlation with
    the implied probability, bets, profit, return. One pass per model, all figures on the
    same rows."""
    reports = []
    for model, df in scored.items():
        bets = with_result_bets(df).select(
            "*", F.col("bet").alias("_bet_r"), F.col("profit").alias("_profit_r")
        )
        bets = with_over_bets(bets)
        implied_h = implied_probabilities([F.col(c) for c in K.RESULT_ODDS])[0]
        implied_over = implied_probabilities([F.col(c) for c in K.OVER_ODDS])[0]
        games = F.count(F.lit(1))
        result = _betting(games, F.col("_bet_r"), F.col("_profit_r"))
        over = _betting(games, F.col("bet"), F.col("profit"))
        right_result = (F.col("result_pred") == F.col("match_result")).cast("double")
        right_over = ((F.col("p_over") >= 0.5).cast("int") == F.col("Over")).cast("double")
        figures = {
            ("result", "accuracy"): F.avg(right_result),
            ("result", "correlation"): correlation(F.col("p_h"), implied_h),
            ("result", "bets"): result["bets"].cast("double"),
            ("result", "profit"): result["total_profit"],
            ("result", "roi"): result["avg_return"],
            ("over", "accuracy"): F.avg(right_over),
            ("over", "correlation"): correlation(F.col("p_over"), implied_over),
            ("over", "bets"): over["bets"].cast("double"),
            ("over", "profit"): over["total_profit"],
            ("over", "roi"): over["avg_return"],
        }
        one = bets.agg(*[c.alias(f"{t}_{m}") for (t, m), c in figures.items()])
        rows = F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("target"), F.lit(m).alias("metric"), F.col(f"{t}_{m}").alias("value"))
                    for t, m in figures
                ]
            )
        )
        reports.append(one.select(F.lit(model).alias("model"), rows.alias("r")).select("model", "r.*"))
    return reduce(DataFrame.unionByName, reports)


def quality_report(scored: dict[str, DataFrame], matches: DataFrame | None = None) -> DataFrame:
    """`(model, target, metric, value)`: accuracy, macro F1, Brier score and log loss of each
    scored frame, and how many of `matches` there are and have all odds (model `all`)."""

    def long(model: str, target: str, one: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), quoted(c).cast("double").alias("value")) for c in one.columns])
        return one.select(F.lit(model).alias("model"), F.lit(target).alias("target"), F.inline(pairs))

    parts = [] if matches is None else [long("all", "matches", odds_coverage(matches))]
    for model, df in scored.items():
        parts += [long(model, "result", result_metrics(df)), long(model, "over", over_metrics(df))]
    return reduce(DataFrame.unionByName, parts)
