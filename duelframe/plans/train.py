"""Train both model variants, evaluate them on the validation season, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.columns import quoted
from duelframe.operators.boosting import Boosted
from duelframe.operators.evaluate import comparison_report, quality_report
from duelframe.operators.modelling import (
    Seasons,
    complete_rows,
    fit_models,
    latest_seasons,
    min_history,
    model_specs,
    score_over,
    score_result,
    select_feature_columns,
    with_split,
    with_targets,
)
from duelframe.session import cut_lineage


@dataclass(frozen=True)
class Trained:
    models: dict[tuple[str, str], Boosted]      # by (variant, target)
    features: list[str]
    seasons: Seasons
    scored: dict[str, DataFrame]    # validation rows with probabilities, by model variant
    report: DataFrame               # (model, target, metric, value)
    quality: DataFrame              # the same columns: further metrics, and matches with odds
    metadata: DataFrame             # one row

    @property
    def result_model(self) -> Boosted:
        return self.models["A", "result"]

    @property
    def over_model(self) -> Boosted:
        return self.models["A", "over"]


def train_and_compare(
    features: DataFrame, params: dict | None = None, source: str = "", variants: tuple[str, ...] = ("A", "B")
) -> Trained:
    """Variant A sees no odds, variant B does. Both are judged on the validation matches
    that have all odds and all features, so every figure is over the same rows. Variant A
    is the one to keep. Only the `variants` asked for are fitted."""
    params = dict(K.BOOSTING if params is None else params)
    names = select_feature_columns(features.columns)
    odds = K.RESULT_ODDS + K.OVER_ODDS
    kept = [c for c in dict.fromkeys([*K.FRONT_COLUMNS, *names, *odds, "match_result"]) if c in {*features.columns, "match_result"}]
    # Read by the season look-up, the bins, the matrix and the validation: computed once.
    ready = cut_lineage(with_targets(min_history(features)).select(*[quoted(c) for c in kept]))
    seasons = latest_seasons(ready)
    parts = with_split(ready, seasons)
    train = parts.filter("split = 'train'")
    validation = complete_rows(parts.filter("split = 'validation'"), names + odds)

    models = fit_models(train, model_specs(names, variants), params)
    scored = {v: score_over(score_result(validation, models[v, "result"]), models[v, "over"]) for v in variants}
    report = comparison_report(scored)
    quality = quality_report(scored, ready)
    return Trained(models, names, seasons, scored, report, quality, model_metadata(train, report, names, seasons, source))


def model_metadata(train: DataFrame, report: DataFrame, names: list[str], seasons: Seasons, source: str) -> DataFrame:
    """One row: features, seasons and the comparison, to be kept next to the models."""
    # Both lists are short whatever the data: seasons are years, the report has 20 rows.
    entry = F.struct(F.concat_ws("_", "model", "target", "metric"), "value")
    comparison = report.agg(F.map_from_entries(F.collect_list(entry)).alias("comparison"))
    return train.agg(F.sort_array(F.collect_set(F.col("season").cast("string"))).alias("train_seasons")).select(
        F.lit(source).alias("parquet"),
        F.array(*[F.lit(n) for n in names]).alias("feature_cols"),
        "train_seasons",
        F.lit(seasons.validation).alias("validation_season"),
        comparison.scalar().alias("comparison"),
    )
