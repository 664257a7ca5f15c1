"""The registered queries over the whole tables, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import (
    bpe,
    curriculum,
    decontaminate,
    filter_audit,
    html_graph,
    langid,
    lengths,
    merkle,
    ngram_join,
    oracles,
    rotated_codes,
    sharding,
    suffix_index,
    wavelet,
)
from duelframe.llm.common import read_table, whole_text

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 by jump hash of doc_id. Null text has size 1 and the crc of no bytes."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(whole_text()) + 1).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
    )
    out = sharding.assign(docs, "doc_id", 8).withColumn("law", F.lit("key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_index.judged(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = whole_text("_row.text").cast("binary")
    kept = F.sha2(F.coalesce("kept", body), 256).alias("kept_sha256")
    return found.select("_row.doc_id", F.octet_length(body).cast("long").alias("n_bytes"), "n_removed", "n_spans", kept)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), VOCABULARY, keep=["doc_id"])
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(read_table(spark, sf_dir, "documents"), VOCABULARY, END_ID))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lengths.token_counts(read_table(spark, sf_dir, "documents"), VOCABULARY, keep=[])
    return lengths.suffix_sums(lengths.histogram(counted))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return rotated_codes.nearest(vectors, "vec_id", "embedding", F.col("id") % 20 == 0, 20)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontaminate.find_items(docs, items, keep=["doc_id"])
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "distances")


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_graph.extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(read_table(spark, sf_dir, "documents"), 3, 90)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets, in training order. `position` is a document's first
    turn, null if it is not taken; `passes` is how often it is."""
    key = F.col("doc_id")
    mixed = curriculum.mix(read_table(spark, sf_dir, "documents"), key, F.col("source"), F.col("text"), {"doc_id": key})
    first = F.get("takes", 0)["position"].alias("position")
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("takes").alias("passes"), first)
    return out.orderBy("position", "doc_id")  # those that are not taken have no position: the id deals them out


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and each row checked against its root after some texts were changed."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    found = F.when(changed, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    leaf = lambda body: merkle.leaf_hash([*map(F.col, ("doc_id", "source", "lang", "n_chars")), body])
    keep = {"doc_id": F.col("doc_id"), "found_leaf": leaf(found)}
    rows = merkle.manifest(read_table(spark, sf_dir, "documents"), F.col("source"), [F.col("doc_id")], leaf(text), keep)
    out = rows.withColumns({"folded_root": merkle.fold(F.col("found_leaf"), F.col("path")), "proof_sha256": merkle.path_hash(F.col("path"))})
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_suffix_dedup,
        op3_bpe,
        op4_nearest,
        op5_token_shards,
        op6_language,
        op7_token_counts,
        op8_decontamination,
        op9_page_text,
        op10_ngram_join,
        op11_mixing,
        op12_filter_audit,
        op13_merkle,
    )
}

ORACLES: dict[str, str] = oracles.ORACLES
