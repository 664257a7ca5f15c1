"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours go to the least node around it. Small star:
    its smaller neighbours and itself do. The least of each node is found by a partial
    aggregate, so a hub costs one row per task there."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    joined = around.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: longs); the component is its
    least node. Each round is stored, which cuts the lineage."""
    now = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    for _ in range(most_rounds):
        after = stored(_star(_star(now, True), False), "edges")
        same = after.select("a", "b").exceptAll(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        done = after.count() == now.count() and same.isEmpty()
        forget(edges.sparkSession, now)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
