"""Corpus listing: files of a folder, or rows of a table, as one ``files`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions.levels import mapped
from auditspark.functions.text import ignored_by, matches
from auditspark.settings import DEFAULT, Settings


def extension(path: Column) -> Column:
    """Lower-case extension, empty for names without one and for dot files."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"[^.].*?\.([^.]*)$", 1))


def language(path: Column) -> Column:
    return mapped(extension(path), fv.LANGUAGE_BY_EXTENSION, "unknown")


def is_testlike(path: Column) -> Column:
    return matches(path, fv.TESTLIKE_PATH)


def skip_reason(path: Column, length: Column, settings: Settings = DEFAULT, ignore: list[str] | None = None,
                gitignore: list[str] | None = None, tool_ignore: list[str] | None = None,
                include: list[str] | None = None) -> Column:
    """Why a file is left out; null when it is kept. The first reason in this order is given."""
    reason = F.when(~extension(path).isin(list(fv.LANGUAGE_BY_EXTENSION)), F.lit("other extension"))
    for patterns, text in (
        (list(fv.DEFAULT_IGNORE) + list(ignore or []), "excluded by default or configured ignore pattern"),
        (gitignore, "excluded by .gitignore"), (tool_ignore, "excluded by the tool's own ignore file"),
    ):
        if patterns:
            reason = reason.when(ignored_by(path, patterns), F.lit(text))
    if include:
        reason = reason.when(~ignored_by(path, include), F.lit("not matched by --include patterns"))
    if settings.max_file_bytes is None:
        return reason
    return reason.when(length > settings.max_file_bytes, F.lit(f"file larger than {settings.max_file_bytes} bytes"))


def listed(candidates: DataFrame, settings: Settings = DEFAULT, **patterns) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of a table with path, length and content.

    Files with another extension are not part of the corpus and are in neither table.
    """
    tagged = candidates.withColumn("reason", skip_reason(F.col("path"), F.col("length"), settings, **patterns))
    files = tagged.where(F.col("reason").isNull()).select(
        "path", language(F.col("path")).alias("language"), is_testlike(F.col("path")).alias("is_testlike"), "length", "content")
    skipped = tagged.where(F.col("reason").isNotNull() & (F.col("reason") != "other extension")).select("path", "reason")
    return files, skipped


def read_folder(spark: SparkSession, root: str, settings: Settings = DEFAULT, **patterns) -> tuple[DataFrame, DataFrame]:
    """Scan a folder tree. Length and path filters run before any file is opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    relative = F.expr(f"substring(path, instr(path, '{marker}') + {len(marker)})")
    candidates = raw.select(
        relative.alias("path"), "length", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return listed(candidates, settings, **patterns)


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines counted from 1."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n", -1)).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line"), "text")
