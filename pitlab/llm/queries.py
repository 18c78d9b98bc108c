"""The registered queries of the subpackage, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlab.llm import bytepairs, chat, decontaminate, interaction, jaccard, langid, neardup, oracles, packing, pii, quality, sharding, toxicity, trie
from pitlab.llm.common import checked

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 1024


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _fold(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_turns(turns.unionByName(extra)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    prototypes = langid.learn(documents.where(_fold(3) != 1).select("text", "lang"))
    found = langid.identify(documents, prototypes)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    labels = quality.majority(_read(spark, sf_dir, "labels"), "quality").where(_fold(4) != 2)
    scored = quality.score(documents, quality.learn(documents, labels))
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    labels = quality.majority(_read(spark, sf_dir, "labels"), "toxic").where(_fold(5) != 0)
    labelled = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(checked(labels), "doc_id")
    scored = toxicity.score(documents, toxicity.train(labelled))
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bytepairs.count_tokens(_read(spark, sf_dir, "documents"), BYTE_VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(decontaminate.find_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_crc32 = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32")
    sharded = sharding.shard(_read(spark, sf_dir, "documents"), carry=[F.col("doc_id"), text_crc32])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = trie.rebuilt(trie.numbered_turns(_read(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, lengths).drop("name", "parent")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_sharding": op11_sharding,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

#: The other operators' methods, or a CRC-32 of whole texts, are beyond SQL; tests hold those against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": oracles.JACCARD_JOIN,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op10_near_duplicates": oracles.NEAR_DUPLICATES,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}
