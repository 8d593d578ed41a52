"""Enriching a registry with what the traces show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions.tables import side_by_side
from auditspark.operators import spans as S


def enrich(agents: DataFrame, summary: DataFrame) -> DataFrame:
    """Registry agents with their observed evidence and liveness."""
    evidence = summary.withColumnRenamed("agent_id", "id")
    return agents.join(evidence, "id", "left").withColumn(
        "liveness_state", F.when(F.col("span_count").isNotNull(), "active").otherwise("idle"))


def merge_findings(findings: DataFrame, runtime_findings: DataFrame) -> DataFrame:
    """Scan findings and runtime findings of all agents in one table."""
    return findings.unionByName(runtime_findings, allowMissingColumns=True)


def coverage(agents: DataFrame, summary: DataFrame, classified: S.Facts, runtime_findings: DataFrame) -> DataFrame:
    """One row: the runtime block of an enriched registry."""
    enriched = agents.select("id").join(
        summary.select(F.col("agent_id").alias("id"), "span_count", "evidence_quality"), "id", "left")
    per_agent = enriched.agg(
        F.count(F.lit(1)).alias("agents_total"), F.count("span_count").alias("agents_covered"),
        *[F.max(F.coalesce((F.col("evidence_quality") == q).cast("int"), F.lit(0))).alias(f"quality_{q}")
          for q in ("content", "mixed", "redacted")])
    subjects = classified.rows("span").groupBy("bucket", "key").agg(F.min("first_at").alias("start_at"), F.max("last_at").alias("end_at"), F.sum("n").alias("n"))
    window = subjects.agg(F.sum("n").alias("span_count"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"),
                          F.count_if(F.col("bucket") == "unmatched").alias("unmatched_agents"))
    found = runtime_findings.agg(F.count(F.lit(1)).alias("rt_findings"))
    return side_by_side([per_agent, window, found])
