"""The training-data pipeline: quality, near duplicates, mixing, token ids.

STAGES lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditspark.llm import bpe_segment_tree, hyperminhash, ordinal_quality, source_mix
from auditspark.llm.common import table
from auditspark.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likelier than not, by a model fitted on `labels`."""
    return ordinal_quality.selected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8), that of the smallest doc_id."""
    return hyperminhash.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; repeats are rows of their own."""
    return source_mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    return bpe_segment_tree.encoded(docs, with_ids=True).drop("decoded")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: No stage can be written in DuckDB's SQL as a whole (a fitted model, HyperMinHash, BPE); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to and read from a new folder beside the checkpoints."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
