"""Merkle manifest of a table: a hash tree per group, and one over the groups.

Rows are leaves. Within a group they ascend by the order columns (nulls first, then by
leaf); every `FAN` consecutive nodes become the hash of their joined hex digests, the last
run having fewer, until one node is left, the group's subroot. Subroots in order of their
group (null first, then bytewise) make the root in the same way. A lone node is not hashed
again.

A level's nodes stand on the rows of their first leaf, `FAN ** level` rows apart, so lag and
lead by that fixed offset, masked by the slot within the run and the run's length, give the
siblings. Windows cover blocks of `FAN ** TIER` rows that never cut a run; a block's top is a
leaf of the next tier. No task sees a group, however large it is.

Awkward rows: a null group is a group of its own; rows equal in every leaf column are leaves
of their own; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import forget, stored
from duelframe.llm.prefix import running_totals

#: Children of a node.
FAN = 3
#: Levels of one tier: blocks of 729 rows.
TIER = 6
BLOCK = FAN**TIER


def joined_hash(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, joined; no part is null."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return joined_hash(*[field(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: joined_hash(step["left"], node, step["right"]))


def path_hash(path: Column) -> Column:
    """Hash of all siblings on the path, level by level, left to right."""
    return joined_hash(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _levels(nodes: DataFrame) -> DataFrame:
    """`nodes` (group, slot, n nodes of the group, hash) with their siblings on the tier's
    levels (`own_path`) and on each block's first row the block's top (`top`)."""
    block = Window.partitionBy("group", "block").orderBy("slot")
    out = nodes.withColumn("block", F.expr(f"slot div {BLOCK}")).withColumn("h0", F.col("hash"))
    steps = []
    for level in range(TIER):
        apart = FAN**level
        node, length = F.expr(f"slot div {apart}"), F.expr(f"(n + {apart - 1}) div {apart}")
        first, place = F.col("slot") % apart == 0, node % FAN
        run = F.least(F.lit(FAN), length - (node - place))
        h = f"h{level}"
        around = {f"before{i}": F.lag(h, i * apart).over(block) for i in range(1, FAN)}
        around |= {f"after{i}": F.lead(h, i * apart).over(block) for i in range(1, FAN)}
        out = out.withColumns(around)
        none = F.lit("")
        left = F.concat(*[F.when(place >= i, F.col(f"before{i}")).otherwise(none) for i in range(FAN - 1, 0, -1)])
        right = F.concat(*[F.when(place + i < run, F.col(f"after{i}")).otherwise(none) for i in range(1, FAN)])
        several = length > 1
        out = out.withColumns(
            {f"step{level}": F.when(first & several, F.struct(left.alias("left"), right.alias("right")))}
        ).withColumn(
            f"h{level + 1}",
            F.when(F.col("slot") % (FAN * apart) == 0, F.when(several, joined_hash(F.col(h), F.col(f"step{level}.right"))).otherwise(F.col(h))),
        )
        upto = block.rowsBetween(Window.unboundedPreceding, 0)
        steps.append(F.last(f"step{level}", ignorenulls=True).over(upto) if level else F.col("step0"))
    out = out.withColumns({f"_filled{i}": s for i, s in enumerate(steps)})
    path = F.filter(F.array(*[F.col(f"_filled{i}") for i in range(TIER)]), lambda s: s.isNotNull())
    return out.select(*nodes.columns, "block", path.alias("own_path"), F.col(f"h{TIER}").alias("top"))


def _climb(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Stored nodes of all tiers above `leaves`; the last has one node a group."""
    tiers = [leaves]
    while most > 1:
        heads = _levels(tiers[-1]).where(F.col("slot") % BLOCK == 0)
        above = heads.select("group", F.col("block").alias("slot"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("hash"))
        tiers.append(stored(above, "merkle"))
        most = -(-most // BLOCK)
    return tiers


def _descend(tiers: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """`tiers[0]` with `path` and the columns `carried` of its group's row in `tops`.

    What belongs to a group comes down block by block: no join has a group as its key,
    but for that of one row a group at the top."""
    down = tiers[-1].join(tops, "group")
    for tier in reversed(tiers[:-1]):
        above = down.select("group", F.col("slot").alias("block"), F.col("path").alias("_above"), *carried)
        whole = F.concat("own_path", "_above").alias("path")
        down = _levels(tier).join(above, ["group", "block"]).select(*tier.columns, whole, *carried)
    return down


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """`rows` with slot and n within their group; the largest n."""
    out = running_totals(rows.withColumn("one", F.lit(1).cast("long")), "group", order, ["one"])
    out = out.withColumnsRenamed({"before_one": "slot", "all_one": "n"}).drop("one")
    kept = stored(out, "merkle")
    return kept, kept.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns `keep` of each row with leaf, subroot, root and path: the siblings
    (`left`, `right`: hex digests, joined) on each level from the leaf up to the root.
    `fold(leaf, path)` is the root."""
    kept = F.struct(*[c.alias(n) for n, c in keep.items()]).alias("kept")
    # A letter before the group keeps null apart and first.
    key = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0")).alias("group")
    ordered = [c.alias(f"order{i}") for i, c in enumerate(order)]
    leaves = stored(rows.select(kept, key, leaf.alias("hash"), *ordered), "merkle")
    numbered, most = _numbered(leaves, [f"order{i}" for i in range(len(order))] + ["hash"])
    tiers = _climb(numbered.select("kept", "group", "slot", "n", "hash"), most)

    subroots = tiers[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "hash")
    upper, groups = _numbered(subroots, ["name"])
    above = _climb(upper, groups)
    roots = above[-1].select("group", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = stored(
        _descend(above, roots, ["root"]).select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "root", "path"), "merkle"
    )
    forget(rows.sparkSession, leaves)
    out = _descend(tiers, tops, ["subroot", "root"])
    return out.select("kept.*", F.col("hash").alias("leaf"), "subroot", "root", "path")
