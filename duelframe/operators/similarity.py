"""Closest name by matching-blocks ratio, without comparing every pair.

ratio(a, b) = 2M / (|a| + |b|), M the characters in matching blocks. For a cut-off c a
pair needs M >= t = ceil(c (|a| + |b|) / 2). M is at most the number of characters both
names hold (as multisets), so with the characters of each name put into one global
order, the first |a| - t + 1 of a and the first |b| - t + 1 of b must share one. Pairs
are found by an equi-join on (length of a, length of b, shared character); no pair above
the cut-off can be lost, and rare characters come first so that few others are found.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters from rare to frequent in European text. Any order is right; this one is quick.
_RARE_FIRST = "zqxjkvbpygfwmucdlhrsnioate "


def _ordered_characters(name: Column) -> Column:
    """Characters as unique tokens (`l1`, `l2` for a double l), rare ones first."""
    chars = F.when(F.char_length(name) > 0, F.split(name, "")).otherwise(F.array().cast("array<string>"))
    occurrence = lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))
    tokens = F.transform(
        chars,
        lambda c, i: F.struct(
            (F.instr(F.lit(_RARE_FIRST), F.lower(c)) / occurrence(c, i)).alias("rank"),
            F.concat(c, occurrence(c, i).cast("string")).alias("token"),
        ),
    )
    return F.transform(F.array_sort(tokens), lambda t: t["token"])


def _needed(a: Column, b: Column, cutoff: float) -> Column:
    """Least M that can reach the cut-off (rounded down a little, the ratio decides)."""
    return F.ceil((a + b) * F.lit(cutoff) / 2 - F.lit(1e-9)).cast("int")


@F.pandas_udf(T.DoubleType())
def _ratio(candidate: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series(
        [difflib.SequenceMatcher(None, c, w).ratio() for c, w in zip(candidate, word)], dtype="float64"
    )


# Marked so that the plan does not compute it once for the filter and again for the score.
_ratio = _ratio.asNondeterministic()


def _keyed(names: DataFrame, column: str, cutoff: float, partner_first: bool) -> DataFrame:
    """One row per possible partner length and token that such a partner may share."""
    # Names too different in length cannot reach the cut-off.
    shortest = F.greatest(F.floor(F.col("_n") * cutoff / (2 - cutoff)).cast("int"), F.lit(1))
    longest = F.ceil(F.col("_n") * (2 - cutoff) / cutoff).cast("int")
    mine, other = F.col("_n"), F.col("_m")
    lengths = ("_lb", "_la") if partner_first else ("_la", "_lb")
    sized = (
        names.select(F.col(column))
        .filter(F.char_length(column) > 0)
        .distinct()
        .select(column, F.char_length(column).alias("_n"), _ordered_characters(F.col(column)).alias("_tokens"))
        .select("*", F.explode(F.sequence(shortest, longest)).alias("_m"))
        .withColumn("_t", _needed(mine, other, cutoff))
        .filter(F.col("_t") <= F.least(mine, other))
        .withColumn("_prefix", F.slice("_tokens", F.lit(1), F.col("_n") - F.col("_t") + 1))
    )
    return sized.select(
        column,
        F.col("_n").alias(lengths[0]),
        F.col("_m").alias(lengths[1]),
        F.col("_tokens").alias(f"_tokens_{column}"),
        F.col("_prefix").alias(f"_prefix_{column}"),
        F.explode("_prefix").alias("_token"),
    )


def similar_pairs(words: DataFrame, candidates: DataFrame, cutoff: float) -> DataFrame:
    """All `(word, candidate, score)` with a ratio of at least `cutoff` (which must be
    above 0). Inputs have one column, `word` and `candidate`; nulls match nothing."""
    if not 0 < cutoff <= 1:
        raise ValueError("the cut-off must be in (0, 1]")
    left = _keyed(words, "word", cutoff, partner_first=False)
    right = _keyed(candidates, "candidate", cutoff, partner_first=True)
    found = left.join(right, ["_la", "_lb", "_token"])
    needed = _needed(F.col("_la"), F.col("_lb"), cutoff)
    shared = F.array_intersect("_tokens_word", "_tokens_candidate")
    # A pair meets once per shared prefix token; the first of them stands for the pair.
    first_shared = F.get(F.array_intersect("_prefix_word", "_prefix_candidate"), F.lit(0))
    plausible = found.filter(
        (F.col("_token") == first_shared)
        & (F.size(shared) >= needed)
        # Matching blocks keep their order, so the rest must be deleted and inserted.
        & (F.levenshtein("word", "candidate") <= F.col("_la") + F.col("_lb") - 2 * needed)
    )
    scored = plausible.select("word", "candidate", _ratio("candidate", "word").alias("score"))
    empty = (
        words.filter(F.char_length("word") == 0).distinct()
        .join(candidates.filter(F.char_length("candidate") == 0).distinct(), F.col("word") == F.col("candidate"))
        .select("word", "candidate", F.lit(1.0).alias("score"))
    )
    return scored.filter(F.col("score") >= cutoff).unionByName(empty)


def closest_names(words: DataFrame, candidates: DataFrame, cutoff: float) -> DataFrame:
    """Per word the candidate of the highest ratio; the larger name wins a tie."""
    best = similar_pairs(words, candidates, cutoff).groupBy("word").agg(
        F.max(F.struct("score", "candidate")).alias("best")
    )
    return best.select("word", F.col("best.candidate").alias("candidate"), F.col("best.score").alias("score"))
