"""Feature choice, targets, season split, boosted trees, scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.columns import all_not_null, quoted
from duelframe.functions.outcomes import first_best_class, result_label
from duelframe.operators import boosting
from duelframe.operators.checks import observed, require_columns
from duelframe.session import cut_lineage


def select_feature_columns(columns: list[str], window: int = K.HISTORY_WINDOW) -> list[str]:
    """Overall trailing means of one window for both sides, and the rating features."""
    wanted = {f"ovr__{stat}__r{window}__{side}" for stat in K.STATS for side in ("h", "a")} | set(K.RATING_COLUMNS)
    return sorted(wanted.intersection(columns))


def min_history(df: DataFrame, games: int = K.HISTORY_GAMES, window: int = K.HISTORY_WINDOW) -> DataFrame:
    """Matches for which both sides have played `games` times within their window."""
    counters = [f"ovr__games__r{window}__{side}" for side in ("h", "a")]
    require_columns(df, counters, "history filter")
    return df.filter((F.col(counters[0]) >= games) & (F.col(counters[1]) >= games))


def with_targets(df: DataFrame) -> DataFrame:
    """Add `match_result`; `Over` must be there already."""
    require_columns(df, ["home_goals", "away_goals", "Over"], "targets")
    return df.withColumn("match_result", result_label(F.col("home_goals"), F.col("away_goals")))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in `columns`; NaN stays."""
    require_columns(df, columns, "complete rows")
    return df.filter(all_not_null(columns))


def complete_rows_counted(df: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, Observation]:
    """`complete_rows`, with `rows` and `dropped` counted while the result is computed."""
    require_columns(df, columns, "complete rows")
    counted, observation = observed(
        df, name, rows=F.count(F.lit(1)), dropped=F.count_if(~all_not_null(columns))
    )
    return counted.filter(all_not_null(columns)), observation


def odds_coverage(df: DataFrame) -> DataFrame:
    """One row: all matches and those with all five odds."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(all_not_null(K.RESULT_ODDS + K.OVER_ODDS)).alias("rows_with_odds"),
    )


@dataclass(frozen=True)
class Seasons:
    current: str
    validation: str


def latest_seasons(df: DataFrame) -> Seasons:
    """The newest season (left out) and the one before it (validation).

    Three rows reach the driver. Fewer than three seasons is an error.
    """
    require_columns(df, ["season"], "season split")
    season = F.col("season").cast("string")
    newest = (
        df.select(season.alias("season")).filter("season is not null").distinct()
        .orderBy(F.col("season").desc()).limit(3).collect()
    )
    if len(newest) < 3:
        raise ValueError("a split needs at least three seasons")
    return Seasons(current=newest[0]["season"], validation=newest[1]["season"])


def _newest_seasons(df: DataFrame):
    """The newest seasons, descending, as a one-row subquery of the plan: no job before the
    action. Seasons are years, so their set is short whatever the data."""
    every = F.sort_array(F.collect_set(F.col("season").cast("string")), asc=False)
    enough = F.when(F.size(every) >= 3, every).otherwise(F.raise_error(F.lit("a split needs at least three seasons")))
    return df.agg(enough.alias("seasons")).scalar()


def with_split(df: DataFrame, seasons: Seasons | None = None) -> DataFrame:
    """Add `split`: train, validation or excluded. Without `seasons` they are looked up while
    the result is computed; fewer than three then fail that job."""
    require_columns(df, ["season"], "season split")
    season = F.col("season").cast("string")
    if seasons:
        current, validation = F.lit(seasons.current), F.lit(seasons.validation)
    else:
        newest = _newest_seasons(df)
        current, validation = newest[0], newest[1]
    return df.withColumn(
        "split",
        F.when(season == current, F.lit("excluded"))
        .when(season == validation, F.lit("validation"))
        .when(season.isNotNull(), F.lit("train")),
    )


def prepare_matrix(train: DataFrame, features: list[str], odds: list[str], bins: int) -> tuple[DataFrame, list[list[float]]]:
    """The stored training matrix of all models and the bin borders of its features and odds:
    rows with all features, binned once, with `result` (class index), `over`, `has_odds`."""
    names = features + odds
    complete = complete_rows(train, features)
    edges = boosting.bin_edges(complete, names, bins)
    result = sum((F.when(F.col("match_result") == c, i).otherwise(0) for i, c in enumerate(K.RESULT_CLASSES)), F.lit(0))
    keep = {
        "result": F.when(F.col("match_result").isNotNull(), result),
        "over": F.col("Over").cast("int"),
        "has_odds": all_not_null(odds),
    }
    matrix = boosting.binned(complete, names, edges, keep)
    return cut_lineage(matrix.withColumn("key", F.xxhash64("codes", "result", "over"))), edges


@dataclass(frozen=True)
class ModelSpec:
    """One model of a training run."""

    variant: str
    target: str             # result or over
    features: list[str]
    needs_odds: bool

    @property
    def classes(self) -> list[str]:
        return K.RESULT_CLASSES if self.target == "result" else ["over"]


def model_specs(features: list[str], variants: tuple[str, ...]) -> list[ModelSpec]:
    """Variant A sees no odds; B sees those of its market and only rows with all odds."""
    specs = [ModelSpec("A", "result", features, False), ModelSpec("A", "over", features, False)]
    specs += [ModelSpec("B", "result", features + K.RESULT_ODDS, True), ModelSpec("B", "over", features + K.OVER_ODDS, True)]
    return [s for s in specs if s.variant in variants]


def fit_models(train: DataFrame, specs: list[ModelSpec], params: dict) -> dict[tuple[str, str], boosting.Boosted]:
    """All models, fitted side by side from one stored matrix, by (variant, target)."""
    bins = (boosting.DEFAULTS | params)["bins"]
    odds = K.RESULT_ODDS + K.OVER_ODDS
    features = [f for f in specs[0].features if f not in odds]
    odds = odds if any(s.needs_odds for s in specs) else []
    matrix, edges = prepare_matrix(train, features, odds, bins)
    slots = max(1, train.sparkSession.sparkContext.defaultParallelism // len(specs))

    @inheritable_thread_target(train.sparkSession)
    def one(spec: ModelSpec) -> boosting.Boosted:
        rows = matrix.where("has_odds") if spec.needs_odds else matrix
        return boosting.fit(rows, spec.target, spec.classes, features + odds, edges, spec.features, params, slots)

    with ThreadPoolExecutor(len(specs)) as pool:
        return dict(zip([(s.variant, s.target) for s in specs], pool.map(one, specs), strict=True))


def score_result(df: DataFrame, model: boosting.Boosted) -> DataFrame:
    """Add `p_a, p_d, p_h` and `result_pred` (class order A, D, H decides a tie)."""
    names = [f"p_{c.lower()}" for c in model.classes]
    scored = boosting.predict(complete_rows(df, model.features), model, names)
    return scored.withColumn("result_pred", first_best_class([(c, F.col(n)) for c, n in zip(model.classes, names, strict=True)]))


def score_over(df: DataFrame, model: boosting.Boosted) -> DataFrame:
    """Add `p_over`."""
    return boosting.predict(complete_rows(df, model.features), model, ["p_over"])


def score(df: DataFrame, result_model: boosting.Boosted, over_model: boosting.Boosted) -> DataFrame:
    """Both models' probabilities on rows that have all features."""
    return score_over(score_result(df, result_model), over_model)
