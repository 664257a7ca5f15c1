"""Running totals inside ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import stored


def running_totals(rows: DataFrame, group: str, order: list[str], amounts: list[str]) -> DataFrame:
    """`rows` with `before_<a>` (the amount of all earlier rows of the group) and `all_<a>`
    (of the whole group) for each of the longs `amounts`; `group` must not be null.

    A range shuffle cuts the order over all groups into parts, so that a group that holds
    most rows is many parts and no task sees it whole. Each part is summed on its own, after
    the sums of the group's earlier parts. Rows equal in `order` follow in the order in which
    they were read; nulls come first. `rows` is read twice: give it stored.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_parts = tied.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    named = sorted_parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    base = stored(named, "ordered")
    sums = base.groupBy(group, "_part").agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    earlier, whole = Window.partitionBy(group).orderBy("_part"), Window.partitionBy(group)
    offsets = sums.select(
        group,
        "_part",
        *[(F.sum(f"_sum_{a}").over(earlier) - F.col(f"_sum_{a}")).alias(f"_offset_{a}") for a in amounts],
        *[F.sum(f"_sum_{a}").over(whole).alias(f"all_{a}") for a in amounts],
    )
    inside = Window.partitionBy(group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    here = base.withColumns({f"_upto_{a}": F.sum(a).over(inside) for a in amounts})
    return here.join(offsets, [group, "_part"]).select(
        *rows.columns,
        *[(F.col(f"_offset_{a}") + F.col(f"_upto_{a}") - F.col(a)).alias(f"before_{a}") for a in amounts],
        *[F.col(f"all_{a}") for a in amounts],
    )
