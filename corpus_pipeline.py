"""The corpus pipeline: documents of known language, one of each near-duplicate group, without
long repeats and without benchmark items, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's `docs`. All but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import bpe, decontaminate, langid, ngram_join, suffix_index
from duelframe.llm.common import forget_since, read_table, stored, without, written_so_far
from duelframe.llm.queries import VOCABULARY

#: Near duplicates: n-grams of so many words, similarity in percent.
WORDS, PERCENT = 5, 80

#: Repeats: strings of so many bytes, shorter than fifty words of any of the languages, and of
#: the seeds that they are found by.
REPEAT, REPEAT_SEED = 200, 64


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one value beside its id and text, so that no column of it can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Without letters there is none:
    such documents and null texts go."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(packed(docs), model, keep=["_row"])
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near duplicates, the one with the least id; one without an id only
    if none of them has one. Rows with the same id but different texts are different documents;
    of rows with the same id and text one stays. Documents without words link with nothing."""
    mark = written_so_far()
    keyed = packed(docs).withColumn("_node", F.xxhash64("doc_id", "text"))
    classes = ngram_join.similarity_classes(keyed.select("_node", "text"), WORDS, PERCENT, key="_node")
    classes = classes.select(F.col("doc_id").alias("_node"), "component_id").distinct()
    named = keyed.select("_node", "doc_id").distinct().join(classes, "_node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_node")).alias("_first")
    stay = named.groupBy("component_id").agg(first).select("_first._node")
    again = keyed.groupBy("_node").agg((F.count("*") > 1).alias("_again"))
    stay = stored(stay.join(again, "_node"), "stay")
    forget_since(spark, mark, stay)
    found = keyed.hint("shuffle_merge").join(stay, "_node")
    once = found.where("not _again").unionByName(found.where("_again").dropDuplicates(["_node"]))
    return once.select("_row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without the bytes of long repeats; `n_chars` follows."""
    cut = suffix_index.remove_repeats(docs, REPEAT, REPEAT_SEED)
    if "n_chars" in cut.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return cut


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontaminate.find_items(packed(docs), read_table(spark, sf_dir, "benchmark"), keep=["_row"])
    return found.where(F.size("item_ids") == 0).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids in place of its text, and the digest of their decoding."""
    coded = bpe.encode_decode(docs, VOCABULARY, keep=without(docs, ["text", "n_tokens", "ids", "decoded"]).columns)
    return coded.withColumn("decoded", F.sha2(F.col("decoded").cast("binary"), 256)).withColumnRenamed("decoded", "decoded_sha256")


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("decontamination", drop_benchmark),
    ("tokens", encode),
]

#: Automata, edit distances and byte pairs are beyond SQL; tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage stored goes once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = written_so_far()
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
