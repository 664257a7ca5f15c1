"""Schema-adaptive column helpers (driver side, no job)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sql_name(name: str) -> str:
    """The name in back-quotes, for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds a dot."""
    return F.col(sql_name(name))


def existing_or_null(df: DataFrame, name: str, alias: str | None = None, type_: str = "double") -> Column:
    """The column if `df` has it, else a typed null."""
    column = quoted(name) if name in df.columns else F.lit(None).cast(type_)
    return column.alias(alias or name)


def known_first(columns: list[str], order: list[str]) -> list[str]:
    """Those of `order` that exist, then the rest in their present order."""
    head = [c for c in order if c in columns]
    return head + [c for c in columns if c not in set(head)]


def not_null_count(df: DataFrame) -> Column:
    """Number of non-null columns in the row."""
    flags = [quoted(c).isNotNull().cast("int") for c in df.columns]
    total = flags[0]
    for flag in flags[1:]:
        total = total + flag
    return total


def all_not_null(columns: list[str]) -> Column:
    """True if no column is null. NaN counts as a value here, unlike in `na.drop`."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & quoted(name).isNotNull()
    return condition
