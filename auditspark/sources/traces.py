"""Span reader: JSONL trace files with headers, bad-line tolerance and read-quality counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.schemas import TRACE_RECORD
from auditspark.session import cut_lineage


def _parsed(raw: DataFrame) -> DataFrame:
    lines = raw.select(
        F.col("_metadata.file_name").alias("trace_file"),
        F.posexplode(F.split("value", "\n", -1)).alias("pos", "text"),
    )
    return parse_lines(lines.select("trace_file", (F.col("pos") + 1).cast("long").alias("trace_line"), "text"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(trace_file, trace_line, text) -> (trace_file, trace_line, record, is_object) of non-blank lines; record null when malformed."""
    # a filter on a generated column is not pushed below its generator, so a line is trimmed and parsed at one place only
    trimmed = lines.select("trace_file", "trace_line", F.explode(F.array(F.btrim("text", F.lit(" \t\n\x0b\f\r")))).alias("text")).where(F.col("text") != "")
    braced = F.col("text").startswith("{")
    parsed = F.struct(
        # only text that parses as a JSON object counts as a record
        F.when(braced, F.from_json("text", TRACE_RECORD, {"mode": "PERMISSIVE"})).alias("record"),
        (braced & F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()).alias("is_object"))
    return trimmed.select("trace_file", "trace_line", F.inline(F.array(parsed)))


def _major(schema: Column) -> Column:
    version = F.substring_index(schema, "/", -1)
    return F.when(schema.contains("/"), F.split_part(version, F.lit("."), F.lit(1))).otherwise(F.lit(""))


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(trace_file, trace_line, text) of all lines; a large file is read as many splits.

    A line's place in its split is how far its row id is from the split's first one, for ids rise by one from row to row
    of a scan. Lines before a split are a running sum over the counts of the file's splits. Splits may fall differently when a
    file is scanned again, so places and counts come from one stored scan.
    """
    raw = spark.read.format("text").option("lineSep", "\n").option("pathGlobFilter", pattern).load(path)
    placed = cut_lineage(raw.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("trace_file"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text")))
    earlier = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("_path", "_split").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines")).select(
        "_path", "_split", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(splits, ["_path", "_split"]).select("trace_file", (F.col("_row") + F.col("_shift")).alias("trace_line"), "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All trace lines of a folder, parsed."""
    return parse_lines(numbered_lines(spark, path))


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    raw = (
        spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.jsonl")
        .option("maxFilesPerTrigger", max_files).load(path)
    )
    return _parsed(raw)


def rejected_from(lines: DataFrame) -> DataFrame:
    """Per file, the line of the first header with an unknown major version.

    Such a header as the first record drops the whole file; later ones are only ignored.
    """
    bad = (F.col("is_object") & F.coalesce(F.col("record.kind") == "header", F.lit(False))
           & ~_major(F.coalesce("record.schema", F.lit(""))).isin("", fv.TRACE_MAJOR))
    # the lowest line with the mark as its last bit, so one aggregate over numbers tells whether the first record is bad
    return lines.groupBy("trace_file").agg(F.min(F.col("trace_line") * 2 + bad.cast("long")).alias("_first")).where(
        F.col("_first") % 2 == 1).select("trace_file")


def typed_spans(lines: DataFrame) -> DataFrame:
    """Span rows of parsed lines, one column per field, with event-time columns added."""
    good = lines.where(F.col("is_object") & F.col("record.kind").isin(fv.SPAN_KINDS))
    return with_times(good.select("trace_file", "trace_line", "record.*").drop("schema", "sdk_version", "dropped_spans"))


def with_times(spans: DataFrame) -> DataFrame:
    return spans.withColumns({
        "start_at": F.try_to_timestamp("start_ts"),
        "end_at": F.try_to_timestamp("end_ts"),
    })


def spans(lines: DataFrame) -> DataFrame:
    """Spans of every accepted file."""
    return typed_spans(lines.join(rejected_from(lines), "trace_file", "left_anti"))


def read_stats(lines: DataFrame) -> DataFrame:
    """One row of read-quality counters over all files."""
    rejected = rejected_from(lines).withColumn("rejected", F.lit(True))
    per_line = lines.join(rejected, "trace_file", "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    kind = F.col("record.kind")
    is_header = F.col("is_object") & F.coalesce(kind == "header", F.lit(False))
    is_span = F.col("is_object") & F.coalesce(kind.isin(fv.SPAN_KINDS), F.lit(False))
    accepted = ~F.col("rejected")
    known = _major(F.coalesce("record.schema", F.lit(""))).isin("", fv.TRACE_MAJOR)
    per_file = per_line.groupBy("trace_file", "rejected").agg(
        F.count_if(accepted & is_span).alias("spans_read"),
        F.count_if(accepted & ~is_header & ~is_span).alias("bad_lines"),
        F.sum(F.when(accepted & is_header & known, F.coalesce("record.dropped_spans", F.lit(0))).otherwise(0)).alias("dropped_spans"),
        F.count_if(accepted & is_header & ~known).alias("late_unknown_headers"),
        F.min(F.when(F.lit(True), F.col("trace_line"))).alias("first_line"),
        F.min(F.when(is_header, F.col("trace_line"))).alias("first_header"),
        # a malformed first line uses up the "first" slot, so it is no missing header
        F.min(F.when(~F.col("is_object"), F.col("trace_line"))).alias("first_malformed"),
        F.max(F.when(accepted & is_header & (F.col("record.redaction") == "redacted"), 1).otherwise(0)).alias("redacted"),
        F.max(F.when(accepted & is_header & (F.col("record.redaction") == "content"), 1).otherwise(0)).alias("content"),
    )
    no_header = (
        ~F.col("rejected")
        & ~F.coalesce(F.col("first_header") == F.col("first_line"), F.lit(False))
        & ~F.coalesce(F.col("first_malformed") == F.col("first_line"), F.lit(False))
    )
    return per_file.agg(
        F.count_if(~F.col("rejected")).alias("files_read"),
        (F.count_if("rejected") + F.sum("late_unknown_headers")).alias("files_skipped"),
        F.sum("spans_read").alias("spans_read"),
        F.sum("bad_lines").alias("bad_lines"),
        F.count_if(no_header).alias("headers_missing"),
        F.sum("dropped_spans").alias("dropped_spans"),
        F.max("redacted").alias("saw_redacted"),
        F.max("content").alias("saw_content"),
    )


def is_off_vocabulary() -> Column:
    """Whether a span names a capability, integration or provider the scanner does not know."""
    def unknown(name, table):
        return F.col(name).isNotNull() & ~F.col(name).isin(list(table))
    return (
        unknown("capability", fv.CAPABILITY_PATTERNS)
        | unknown("integration", fv.INTEGRATION_PATTERNS)
        | unknown("provider", fv.PROVIDER_PATTERNS)
    )


def redacted_attrs(attrs: Column) -> Column:
    """Numbers and booleans pass; any other text becomes its hash and its length.

    Attributes arrive as text, so a value counts as a number or boolean when it reads as one.
    """
    def keep(v):
        return v.rlike(r"^(?:true|false|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)$")

    entries = F.transform(
        F.map_entries(attrs),
        lambda e: F.when(keep(e["value"]), F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))
        .otherwise(F.array(
            F.struct(F.concat(e["key"], F.lit("_sha256")).alias("key"), F.sha2(e["value"], 256).alias("value")),
            F.struct(F.concat(e["key"], F.lit("_chars")).alias("key"), F.length(e["value"]).cast("string").alias("value")),
        )),
    )
    return F.map_from_entries(F.flatten(entries))
