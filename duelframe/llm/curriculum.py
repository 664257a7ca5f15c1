"""Mixing of sources to target weights, with weights that change over the training.

Each source has a schedule: a weight over the training time 0 to 1, linear between knots. Its
integral is the source's share, and its running integral says how much of the source has been
asked for at each time. A source's documents stand in a fixed random order; a document's turn
comes when the demand has reached the words before it, which the inverse of the running
integral gives in closed form. Sorting by that position gives the training order.

Main path in DataFrame functions only. Awkward rows: null and wordless texts have size 0 and
are never taken; a null source is a source of its own, after all others; rows equal in id and
text are interchangeable; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import stored
from duelframe.llm.prefix import running_totals

#: Schedules in turn, as knots (time, weight); their integrals are the weights 5, 2 and 1.
SCHEDULES = (
    ((0.0, 8.0), (1.0, 2.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.0), (0.5, 0.5), (1.0, 3.0)),
)
#: All words taken, as a fraction of all words there are.
SHARE = (3, 2)
#: A document is taken at most so often.
PASSES = 2

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def segments(knots) -> list[tuple[float, float, float, float]]:
    """(start time, weight there, slope, integral before) for each stretch of a schedule."""
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, w0, (w1 - w0) / (t1 - t0), done))
        done += (w0 + w1) / 2 * (t1 - t0)
    return out


def integral(knots) -> float:
    return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def _schedule_column(schedules, rank: Column) -> Column:
    names = ("start", "weight", "slope", "done")
    rows = [F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s, strict=True)]) for s in segments(k)]) for k in schedules]
    return F.element_at(F.array(*rows), (rank % len(schedules) + 1).cast("int"))


def time_of(stretches: Column, demand: Column) -> Column:
    """The time at which the running integral of a schedule reaches `demand`."""
    last = F.try_element_at(F.filter(stretches, lambda s: s["done"] <= demand), F.lit(-1))
    left = demand - last["done"]
    root = F.sqrt(F.greatest(last["weight"] * last["weight"] + 2.0 * last["slope"] * left, F.lit(0.0)))
    return F.when(left <= 0.0, last["start"]).otherwise(last["start"] + 2.0 * left / (last["weight"] + root))


def targets(sizes: DataFrame, schedules=SCHEDULES, share=SHARE, passes: int = PASSES) -> DataFrame:
    """`sizes` (group, source_size; one row a source) with `target` and the source's schedule.

    Targets share `share` of all words by weight. A source whose target would pass `passes`
    times its size stops there, and the excess is shared out again: sources in order of size by
    weight are full as long as their part of what the ones before them leave is enough. One
    window holds one row a source.
    """
    upper, lower = share
    rank = F.row_number().over(Window.orderBy("group")) - 1
    weights = F.array(*[F.lit(integral(k)) for k in schedules])
    out = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(weights, (F.col("rank") % len(schedules) + 1).cast("int")))
    whole = Window.partitionBy(F.lit(0))
    filling = whole.orderBy(F.col("source_size") / F.col("weight"), "group").rowsBetween(Window.unboundedPreceding, 0)
    size, weight = F.col("source_size"), F.col("weight")
    out = out.withColumns(
        {
            "_words": F.sum(size).over(whole),
            "_earlier": F.sum(size).over(filling) - size,
            "_rest": F.sum(weight).over(whole) - F.sum(weight).over(filling) + weight,
        }
    )
    left = F.col("_words") * upper - F.col("_earlier") * (passes * lower)
    out = out.withColumn("_full", size * (passes * lower) * F.col("_rest") <= weight * left)
    full_words = F.sum(F.when(F.col("_full"), size).otherwise(F.lit(0))).over(whole)
    open_weight = F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(weight)).over(whole)
    part = weight * (F.col("_words") * upper - full_words * (passes * lower)) / F.nullif(open_weight * lower, F.lit(0.0))
    target = F.when(F.col("_full"), (size * passes).cast("double")).otherwise(part)
    return out.select("group", target.alias("target"), weight.alias("weight"), _schedule_column(schedules, F.col("rank")).alias("schedule"))


def mix(
    docs: DataFrame,
    key: Column,
    source: Column,
    text: Column,
    keep: dict[str, Column],
    schedules=SCHEDULES,
    share=SHARE,
    passes: int = PASSES,
) -> DataFrame:
    """The columns `keep` of each document with size, source_size, target, taken (words) and
    takes: (pass, words, position) for each time it is taken. The last document that a source
    needs is taken in part, its first words, so that a source gives its target to the word."""
    body = text.cast("string")
    name = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(F.md5(body.cast("binary")), F.lit("-")))
    rows = docs.select(
        F.struct(*[c.alias(n) for n, c in keep.items()]).alias("kept"),
        F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1")).alias("group"),
        F.md5(name.cast("binary")).alias("turn"),
        word_count(body).alias("size"),
    )
    placed = running_totals(stored(rows, "mix"), "group", ["turn"], ["size"])
    placed = stored(placed, "mix")
    sizes = placed.groupBy("group").agg(F.max("all_size").alias("source_size"))
    # One row a source: its sums are in one window above, so it is as small as a broadcast needs.
    wanted = placed.join(targets(sizes, schedules, share, passes), "group")
    words = F.floor(F.col("target") + 0.5).cast("long")
    takes = [
        F.struct(
            F.lit(i + 1).alias("pass"),
            F.greatest(F.lit(0).cast("long"), F.least("size", words - F.col("all_size") * i - F.col("before_size"))).alias("words"),
            time_of(
                F.col("schedule"), (F.col("all_size") * i + F.col("before_size")) / F.nullif(words, F.lit(0).cast("long")) * F.col("weight")
            ).alias("position"),
        )
        for i in range(passes)
    ]
    out = wanted.withColumn("takes", F.filter(F.array(*takes), lambda t: t["words"] > 0))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda sum_, t: sum_ + t["words"])
    return out.select("kept.*", "size", F.col("all_size").alias("source_size"), "target", taken.alias("taken"), "takes")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each take, range-sorted by its position in the training."""
    flat = mixed.select(*[c for c in mixed.columns if c != "takes"], F.inline("takes"))
    return flat.orderBy("position", "pass")
