"""Feeds that arrive as text: commit logs, unified diffs, owner files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators.findings import parse_owners
from auditspark.schemas import STR, struct

LOG_SEPARATOR = "\x1f"


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """(path, author, hash, date) of an exported commit log; rows with other field counts are dropped."""
    raw = spark.read.option("mode", "DROPMALFORMED").schema(struct(path=STR, author=STR, hash=STR, date=STR)).csv(
        path, sep=LOG_SEPARATOR)
    return raw.where(F.col("date").isNotNull())


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, text): one row per diff file."""
    return spark.read.format("text").option("wholetext", True).load(path).select(
        F.col("_metadata.file_name").alias("diff_id"), F.col("value").alias("text"))


def read_owners(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """The ordered owner rules of one configuration file (hosts limit such files to a few MB).

    Of several files the one whose place comes first is read: a hosting folder, the top, a documentation folder.
    """
    place = F.when(F.col("_metadata.file_path").rlike(r"/\.github/[^/]*$"), 0).when(F.col("_metadata.file_path").rlike(r"/docs/[^/]*$"), 2).otherwise(1)
    files = spark.read.format("text").option("wholetext", True).load(path)
    rows = files.orderBy(place, F.col("_metadata.file_path")).limit(1).collect()
    return parse_owners(rows[0]["value"]) if rows else []
