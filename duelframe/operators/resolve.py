"""Layered entity resolution: raw names to canonical names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe import constants as K
from duelframe.functions.text import normalised_name
from duelframe.operators.mapping import unique_map
from duelframe.operators.similarity import closest_names


@dataclass(frozen=True)
class Cascade:
    """The order of the steps, what an override needs, and what happens at the end.

    steps: any of `override`, `exact`, `normalised`, `fuzzy`, in order.
    unknown_target: an override to a name that is not canonical is used (`use`), ends the
    search without a match (`drop`), or is passed over (`skip`).
    fallback: `identity` keeps the raw name, `none` leaves null.
    """

    steps: tuple[str, ...]
    unknown_target: str = "use"
    cutoff: float = K.FUZZY_CUTOFF
    fallback: str = "identity"


FIRST_SOURCE = Cascade(("override",))
SECOND_SOURCE = Cascade(("override", "exact", "normalised", "fuzzy"))
RATING_SOURCE = Cascade(
    ("exact", "override", "fuzzy"), unknown_target="drop", cutoff=K.FUZZY_CUTOFF_STRICT, fallback="none"
)
DIRECT_PAIR = Cascade(("exact", "normalised", "override", "fuzzy"), unknown_target="skip", fallback="none")


def resolve_names(names: DataFrame, canonical: DataFrame, overrides: DataFrame, cascade: Cascade) -> DataFrame:
    """`(raw, canonical, method)` for every distinct raw name.

    names: column `raw`; canonical: column `name`; overrides: `(raw, canonical)`.
    Each step is a left join that offers a candidate; the first step that has one wins.
    `method` tells which, `unmatched` if none, `override_target_missing` if an override
    ended the search.
    """
    raw = names.select("raw").filter(F.col("raw").isNotNull()).distinct()
    targets = canonical.select("name").filter(F.col("name").isNotNull()).distinct()

    joined = raw
    if "override" in cascade.steps:
        given = unique_map(overrides).withColumnRenamed("canonical", "_override")
        joined = joined.join(given, "raw", "left")
        known = targets.select(F.col("name").alias("_override"), F.lit(True).alias("_known"))
        joined = joined.join(known, "_override", "left")
    if "exact" in cascade.steps:
        joined = joined.join(targets.select(F.col("name").alias("raw"), F.col("name").alias("_exact")), "raw", "left")
    if "normalised" in cascade.steps:
        # Several canonical names may normalise to one key: the smallest stands for it.
        by_key = targets.groupBy(normalised_name(F.col("name")).alias("_key")).agg(F.min("name").alias("_normalised"))
        joined = joined.withColumn("_key", normalised_name(F.col("raw"))).join(by_key, "_key", "left")

    target, method = F.lit(None).cast("string"), F.lit(None).cast("string")
    for step in reversed([s for s in cascade.steps if s != "fuzzy"]):
        candidate = F.col(f"_{step}")
        if step == "override" and cascade.unknown_target != "use":
            found = candidate.isNotNull() & F.coalesce("_known", F.lit(False))
        else:
            found = candidate.isNotNull()
        if step == "override" and cascade.unknown_target == "drop":
            dead = candidate.isNotNull() & ~F.coalesce("_known", F.lit(False))
            target = F.when(dead, F.lit(None)).otherwise(target)
            method = F.when(dead, F.lit("override_target_missing")).otherwise(method)
        target = F.when(found, candidate).otherwise(target)
        method = F.when(found, F.lit(step)).otherwise(method)
    resolved = joined.select("raw", target.alias("_target"), method.alias("_method"))

    if "fuzzy" in cascade.steps:
        open_names = resolved.filter(F.col("_method").isNull()).select(F.col("raw").alias("word"))
        close = closest_names(open_names, targets.select(F.col("name").alias("candidate")), cascade.cutoff)
        resolved = resolved.join(close.select(F.col("word").alias("raw"), "candidate"), "raw", "left").select(
            "raw",
            F.coalesce("_target", "candidate").alias("_target"),
            F.when(F.col("_method").isNull() & F.col("candidate").isNotNull(), F.lit("fuzzy"))
            .otherwise(F.col("_method")).alias("_method"),
        )

    unresolved = F.col("_method").isNull()
    last = F.col("raw") if cascade.fallback == "identity" else F.lit(None).cast("string")
    return resolved.select(
        "raw",
        F.when(unresolved, last).otherwise(F.col("_target")).alias("canonical"),
        F.coalesce("_method", F.lit("identity" if cascade.fallback == "identity" else "unmatched")).alias("method"),
    )


def as_name_map(resolved: DataFrame) -> DataFrame:
    """The usable part of a resolution: rows that have a canonical name."""
    return resolved.filter(F.col("canonical").isNotNull()).select("raw", "canonical")
