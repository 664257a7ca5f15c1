"""Labels, probabilities, odds and rating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe import constants as K


def over_flag(home_goals: Column, away_goals: Column, line: float = K.OVER_LINE) -> Column:
    """1 if more goals than the line, null for an unplayed match."""
    return (home_goals + away_goals > F.lit(line)).cast("tinyint")


def result_label(home_goals: Column, away_goals: Column) -> Column:
    """H, A or D; an unplayed match is D because neither test holds."""
    return (
        F.when(home_goals > away_goals, F.lit("H"))
        .when(home_goals < away_goals, F.lit("A"))
        .otherwise(F.lit("D"))
    )


def over_under_label(p_over: Column) -> Column:
    """The label counts an even chance as Over (a bet would not)."""
    return F.when(p_over >= 0.5, F.lit("Over")).otherwise(F.lit("Under"))


def first_best_class(probabilities: list[tuple[str, Column]]) -> Column:
    """Class of the highest probability; the earlier class wins a tie."""
    best = F.greatest(*[p for _, p in probabilities])
    label = F.lit(None).cast("string")
    for name, p in reversed(probabilities):
        label = F.when(p == best, F.lit(name)).otherwise(label)
    return label


def inverse(value: Column) -> Column:
    """1/value with 1/0 = infinity."""
    return F.when(value == 0, F.lit(float("inf"))).otherwise(1 / F.when(value != 0, value))


def rounded(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: what array libraries do with doubles."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def fair_odds(probability: Column, digits: int = 2) -> Column:
    """Odds of a probability; those of an impossible outcome are infinite."""
    return rounded(inverse(probability), digits)


def implied_probabilities(odds: list[Column]) -> list[Column]:
    """Bookmaker odds to probabilities that add up to one."""
    raw = [inverse(o) for o in odds]
    total = raw[0]
    for r in raw[1:]:
        total = total + r
    return [r / total for r in raw]


def coalesced_odds(available: list[str], precedence: list[str], alias: str) -> Column:
    """First non-null of the listed columns that exist; null if none exists."""
    from duelframe.functions.columns import quoted

    present = [quoted(c).cast("double") for c in precedence if c in set(available)]
    return (F.coalesce(*present) if present else F.lit(None).cast("double")).alias(alias)


def rating_features(home: Column, away: Column) -> list[Column]:
    """Difference, sum and mean of two ratings."""
    return [
        (home - away).alias("elo_diff"),
        (home + away).alias("elo_sum"),
        ((home + away) / 2).alias("elo_mean"),
    ]
