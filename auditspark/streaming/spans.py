"""Streaming jobs over spans: redaction, counters, limits, approval rates, sessions, alerts, dedupe.

Each job is a plain transformation that works on a stream and on a table alike. ``run`` drives a
stream to its end and lands the result in a table next to the checkpoints, never in the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.operators import spans as S
from auditspark.session import ensure_checkpoint_dir
from auditspark.sources import declarations, derived
from auditspark.sources.traces import is_off_vocabulary, redacted_attrs


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bench events as a file stream of spans."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1000).parquet(sf_dir)
    return derived.spans_of(raw)


def run(result: DataFrame, mode: str) -> DataFrame:
    """Run a stream over everything available and return the landed table.

    ``complete`` rewrites the whole result per batch and so returns every window; ``append`` keeps
    back what the watermark has not passed.
    """
    spark = result.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    writer = result.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(f"{folder}/out")
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, _id: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


# ------------------------------------------------------------------ jobs

def redact_spans(spans: DataFrame) -> DataFrame:
    """Spans whose attributes are hashed unless they are numbers or booleans; off-vocabulary names are marked."""
    return spans.withColumns({
        "attrs": redacted_attrs(F.col("attrs")), "vocabulary": F.when(is_off_vocabulary(), "custom")})


def hourly_counters_of(spans: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Running counters per agent and window."""
    high = S.is_high_impact_action()
    return (
        spans.withWatermark("start_at", watermark).groupBy(F.window("start_at", window).alias("w"), "agent_id").agg(
            F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("status") == "error").alias("errors"),
            F.count_if(high).alias("high_impact_actions"), F.count_if(high & S.is_approved()).alias("high_impact_approved"))
        .select(F.col("w.start").alias("window_start"), "agent_id", "span_count", "errors", "high_impact_actions", "high_impact_approved"))


def daily_totals_of(spans: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Exact money moved per agent, currency and day."""
    return (
        spans.where(F.col("amount.amount").isNotNull()).withWatermark("start_at", watermark)
        .groupBy(F.window("start_at", "1 day").alias("w"), "agent_id", F.col("amount.currency").alias("currency"))
        .agg(F.sum(F.col("amount.amount").cast("decimal(24,4)")).cast("double").alias("total"))
        .select(F.col("w.start").alias("day"), "agent_id", "currency", "total"))


def over_daily_limit(totals: DataFrame, declared: DataFrame) -> DataFrame:
    """Days on which an agent moved more than its declared daily limit in the same currency."""
    limits = declared.select("agent_id", F.col("economic_authority.daily_aggregate.amount").alias("daily_limit"),
                             F.col("economic_authority.daily_aggregate.currency").alias("currency")).where(F.col("daily_limit").isNotNull())
    return totals.join(limits, ["agent_id", "currency"]).where(F.col("total") > F.col("daily_limit"))


def approval_rates_of(spans: DataFrame, watermark: str = "1 hour", window: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Sliding approval rate of high-impact actions."""
    return (
        spans.where(S.is_high_impact_action()).withWatermark("start_at", watermark)
        .groupBy(F.window("start_at", window, slide).alias("w"), "agent_id")
        .agg(F.count(F.lit(1)).alias("actions"), F.count_if(S.is_approved()).alias("approved"))
        .select(F.col("w.start").alias("window_start"), "agent_id", "actions", "approved",
                F.bround(F.col("approved") / F.col("actions"), 4).alias("rate")))


def approval_drops_of(rates: DataFrame, baseline: DataFrame, drop: float = fv.APPROVAL_DROP) -> DataFrame:
    """Windows whose rate fell below the agent's baseline (agent_id, approval_rate) by the threshold."""
    return rates.join(baseline.where(F.col("approval_rate").isNotNull()).select("agent_id", "approval_rate"), "agent_id").where(
        F.col("approval_rate") - F.col("rate") >= drop)


def sessions_of(spans: DataFrame, watermark: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Bursts of an agent's activity separated by a quiet gap."""
    return (
        spans.withWatermark("start_at", watermark).groupBy(F.session_window("start_at", gap).alias("w"), "agent_id")
        .agg(F.count(F.lit(1)).alias("span_count"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "agent_id", "span_count"))


def unapproved_alerts(spans: DataFrame, wait: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """High-impact actions for which no approval span of the trace arrived in time (append mode)."""
    actions = spans.where(S.is_high_impact_action()).select(
        "trace_id", "agent_id", "span_id", F.col("start_at").alias("acted_at")).withWatermark("acted_at", watermark)
    approvals = spans.where(F.col("kind") == "approval").select(
        F.col("trace_id").alias("a_trace"), F.col("end_at").alias("granted_at")).withWatermark("granted_at", watermark)
    joined = actions.join(
        approvals, F.expr(f"trace_id = a_trace AND granted_at BETWEEN acted_at - INTERVAL {wait} AND acted_at + INTERVAL {wait}"), "left_outer")
    return joined.where(F.col("granted_at").isNull()).select("trace_id", "agent_id", "span_id", "acted_at")


def deduplicated(spans: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Replayed spans are dropped within the watermark (streams only)."""
    return spans.withWatermark("start_at", watermark).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def dead_letters(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) parsed trace lines; bad ones keep their file and line for a dead-letter table."""
    good = F.col("is_object") & F.coalesce(F.col("record.kind").isin([*fv.SPAN_KINDS, "header"]), F.lit(False))
    return lines.where(good), lines.where(~good).select("trace_file", "trace_line")


# ------------------------------------------------------------------ registered streams

def _given(spark, sf_dir):
    return stream_events(spark, sf_dir).where(F.col("agent_id").isNotNull())


def hourly_counters(spark, sf_dir):
    r = run(hourly_counters_of(_given(spark, sf_dir)), "complete")
    return r.withColumn("window_start", S.iso(F.col("window_start")))


def daily_breaches(spark, sf_dir):
    totals = run(daily_totals_of(_given(spark, sf_dir)), "complete")
    declared = declarations.valid_declared(derived.declared(spark, sf_dir))
    return over_daily_limit(totals, declared).withColumn("day", S.iso(F.col("day")))


def approval_windows(spark, sf_dir):
    r = run(approval_rates_of(_given(spark, sf_dir)), "complete")
    return r.withColumn("window_start", S.iso(F.col("window_start")))


def sessions(spark, sf_dir):
    r = run(sessions_of(_given(spark, sf_dir)), "complete")
    return r.select(S.iso(F.col("session_start")).alias("session_start"), S.iso(F.col("session_end")).alias("session_end"), "agent_id", "span_count")


def redacted(spark, sf_dir):
    r = run(redact_spans(stream_events(spark, sf_dir)).select("span_id", "attrs", "vocabulary"), "append")
    return r.select("span_id", "vocabulary", F.col("attrs")["k"].alias("k"), F.col("attrs")["event_sha256"].alias("event_sha256"),
                    F.col("attrs")["event_chars"].alias("event_chars"))


def batch_result(job, spark, sf_dir):
    return job(spark, sf_dir)
