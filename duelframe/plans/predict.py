"""Score coming matches and lay out the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from duelframe import constants as K
from duelframe.operators.boosting import Boosted
from duelframe.operators.checks import require_columns
from duelframe.operators.modelling import complete_rows_counted, min_history, score
from duelframe.operators.report import coming_matches, prediction_report


def predict_coming_counted(
    features: DataFrame,
    result_model: Boosted,
    over_model: Boosted,
    as_of: str,
    days: int = K.REPORT_DAYS,
    history_filter: bool = False,
) -> tuple[DataFrame, Observation]:
    """Report rows for matches in `[as_of, as_of + days)` that have all features, and how
    many matches there were and how many were dropped (known once the report is written).

    The date filter comes first and reaches the scan. `history_filter` asks for the same
    number of earlier games as training does.
    """
    needed = result_model.features
    require_columns(features, needed, "scoring")
    coming = coming_matches(features, as_of, days)
    if history_filter:
        coming = min_history(coming)
    complete, counts = complete_rows_counted(coming, needed, "coming matches")
    return prediction_report(score(complete, result_model, over_model)), counts


def predict_coming(
    features: DataFrame, result_model: Boosted, over_model: Boosted, as_of: str, **options
) -> DataFrame:
    """The report alone."""
    return predict_coming_counted(features, result_model, over_model, as_of, **options)[0]
