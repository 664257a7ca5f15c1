"""The table of coming matches with predictions and odds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.columns import quoted
from duelframe.functions.outcomes import fair_odds, first_best_class, over_under_label, rounded


def coming_matches(df: DataFrame, as_of: str, days: int = K.REPORT_DAYS) -> DataFrame:
    """Matches from `as_of` on for `days` days. Plain comparisons, so the scan can skip files."""
    start = F.lit(as_of).cast("timestamp_ntz")
    return df.filter((F.col("date") >= start) & (F.col("date") < start + F.expr(f"INTERVAL {int(days)} DAYS")))


def prediction_report(scored: DataFrame, time_zone: str = K.REPORT_TIME_ZONE) -> DataFrame:
    """Local day and time, label, probabilities and fair odds next to the bookmaker's.

    Odds come from the unrounded probability.
    """
    utc = F.col("date").cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc)
    p_over, p_under = F.col("p_over"), 1 - F.col("p_over")
    values = {
        "Day": F.date_format(local, "yyyy-MM-dd"),
        "Time": F.date_format(local, "HH:mm"),
        "league": F.col("league"),
        "home_team": F.col("home_team"),
        "away_team": F.col("away_team"),
        "Result_Pred": first_best_class([(c, F.col(f"p_{c.lower()}")) for c in K.RESULT_CLASSES]),
        "Over_Under_Pred": over_under_label(p_over),
        "Prob_Over_2.5": rounded(p_over, 3),
        "Odds_Over_2.5": fair_odds(p_over),
        "Prob_Under_2.5": rounded(p_under, 3),
        "Odds_Under_2.5": fair_odds(p_under),
    }
    for c in K.RESULT_CLASSES:
        values[f"Prob_{c}"] = rounded(F.col(f"p_{c.lower()}"), 3)
        values[f"Odds_{c}"] = fair_odds(F.col(f"p_{c.lower()}"))
    for source, name in K.BOOKMAKER_COLUMNS.items():
        if source in scored.columns:
            values[name] = quoted(source)
    return scored.select(*[values[c].alias(c) for c in K.REPORT_COLUMNS if c in values])
