"""Text expressions for names and path keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_name(name: Column) -> Column:
    """Lower case, trimmed, without space, dot and dash; empty for null."""
    # \s at both ends: trimming covers tabs and line ends, the inner rule only the space.
    trimmed = F.regexp_replace(F.lower(name), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.translate(trimmed, " .-", ""), F.lit(""))


def path_key(name: Column) -> Column:
    """Spaces to underscores."""
    return F.replace(name, F.lit(" "), F.lit("_"))
