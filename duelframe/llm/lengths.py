"""Exact histogram of document lengths in tokens.

Documents are counted by encoded length; suffix sums over the histogram then answer
totals, quantiles and truncated totals for every context limit. Null text has length 0.
The suffix sums go block by block: a running total inside each block of lengths, and one
over the blocks, whose number follows the longest document, not the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from duelframe.llm.bpe import vocabulary
from duelframe.llm.common import add_columns, stored, whole_text

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def token_counts(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `length`, its text's number of tokens."""

    def work():
        model = vocabulary(path)
        return lambda columns: [pa.array(model.encode_batch(columns[0].to_pylist())[1].astype(np.int64))]

    return add_columns(docs, [whole_text()], [StructField("length", LongType())], work, keep)


def histogram(counted: DataFrame) -> DataFrame:
    """Documents by length: length, n_docs, n_tokens."""
    grouped = counted.groupBy("length").agg(F.count("*").alias("n_docs"))
    return grouped.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for each length taken as a context limit: docs_at_least and
    tokens_at_least (documents that long or longer), truncated_tokens (all documents cut to
    the limit) and docs_upto (documents not longer: the quantile that the length stands at)."""
    # Both the sums and the rows that they join read it: the texts are encoded once.
    rows = stored(hist.withColumn("_block", F.floor(F.col("length") / BLOCK)), "lengths")
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    later, every = Window.orderBy(F.desc("_block")), Window.partitionBy(F.lit(0))
    after = [(F.sum(c).over(later) - F.col(c)).alias(f"{c}_after") for c in ("_docs", "_tokens")]
    totals = [F.sum(c).over(every).alias(f"{c}_all") for c in ("_docs", "_tokens")]
    blocks = blocks.select("_block", *after, *totals)
    inside = Window.partitionBy("_block").orderBy(F.desc("length"))
    rows = rows.withColumn("_d", F.sum("n_docs").over(inside)).withColumn("_t", F.sum("n_tokens").over(inside))
    docs_here, tokens_here = F.col("_d") + F.col("_docs_after"), F.col("_t") + F.col("_tokens_after")
    return rows.join(blocks, "_block").select(
        "length",
        "n_docs",
        "n_tokens",
        docs_here.alias("docs_at_least"),
        tokens_here.alias("tokens_at_least"),
        (F.col("_tokens_all") - tokens_here + F.col("length") * docs_here).alias("truncated_tokens"),
        (F.col("_docs_all") - docs_here + F.col("n_docs")).alias("docs_upto"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share in (0, 1]: the least length that so many documents do not exceed."""
    total = F.max(F.col("docs_upto"))
    picks = [F.min(F.when(F.col("docs_upto") >= F.lit(s) * F.col("_all"), F.col("length"))) for s in shares]
    rows = sums.crossJoin(F.broadcast(sums.agg(total.alias("_all"))))  # one row
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), p.alias("length")) for s, p in zip(shares, picks, strict=True)])
    return rows.agg(pairs.alias("_q")).select(F.inline("_q"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, whether or not a document has just that length: all tokens
    left when every document is cut to it."""
    cut = [F.coalesce(F.sum(F.least("length", F.lit(n)) * F.col("n_docs")), F.lit(0)) for n in limits]
    pairs = F.array(*[F.struct(F.lit(int(n)).cast("long").alias("context"), c.alias("tokens")) for n, c in zip(limits, cut, strict=True)])
    return hist.agg(pairs.alias("_t")).select(F.inline("_t"))
