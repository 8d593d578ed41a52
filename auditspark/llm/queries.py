"""The operators of this folder as registered queries: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import (bloom_ranking, bpe_segment_tree, conversation_repair, edit_token_counts, feistel_sharding, hyperminhash, id_range_coder, licence_index, ordinal_quality,
                            perplexity_rules, pivot_topk, source_mix, weighted_fingerprints)
from auditspark.llm.common import table, text_or_empty


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edit_token_counts.trees(table(spark, sf_dir, "documents"))
    counted = edit_token_counts.recounted(docs, edit_token_counts.own_edits(text_or_empty()))
    return counted.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited", "leaf_lengths", "leaf_tokens")


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_sharding.shard(table(spark, sf_dir, "documents"))


def op5_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_index.scan(table(spark, sf_dir, "documents"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op7_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_segment_tree.encoded(table(spark, sf_dir, "documents"))


def op8_id_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_range_coder.round_trip(table(spark, sf_dir, "documents"))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules.judged(table(spark, sf_dir, "documents"))


def op13_bloom_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


Q = {name: f for name, f in list(globals().items()) if name.startswith("op") and name[2].isdigit()}
