"""Static exposure ranking of agents and severity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.functions.tables import side_by_side


def highest_severity(findings: DataFrame) -> DataFrame:
    """(agent_id, highest_severity) over unsuppressed findings."""
    return findings.where(~F.col("suppressed")).groupBy("agent_id").agg(
        L.severity(F.max(L.severity_rank(F.col("severity")))).alias("highest_severity"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, total, new, suppressed): totals and new ones are unsuppressed."""
    open_ = ~F.col("suppressed")
    return findings.groupBy("severity").agg(
        F.count_if(open_).alias("total"), F.count_if(open_ & F.col("is_new")).alias("new"),
        F.count_if("suppressed").alias("suppressed"))


def _common(col: str, values) -> Column:
    return F.size(F.array_intersect(F.col(col), L.string_array(values)))


def score(agents_with_severity: DataFrame) -> DataFrame:
    """Adds exposure_score, exposure_tier and is_high_exposure; needs ``highest_severity``."""
    high, sensitive = _common("capabilities", fv.HIGH_IMPACT_CAPABILITIES), _common("integrations", fv.SENSITIVE_INTEGRATIONS)
    points = (
        3 * high + 2 * sensitive + F.size("integrations")
        + 2 * F.coalesce(L.mapped(F.col("highest_severity"), fv.EXPOSURE_SEVERITY_RANK, 0), F.lit(0))
        + F.when(F.col("confidence") == "high", 2).otherwise(0))
    tier = F.lit(fv.EXPOSURE_TIERS[-1][1])
    for threshold, name in reversed(fv.EXPOSURE_TIERS):
        tier = F.when(points >= threshold, name).otherwise(tier)
    return agents_with_severity.withColumns({
        "exposure_score": points.cast("int"), "exposure_tier": tier,
        "is_high_exposure": (high > 0) | (sensitive >= 2) | F.coalesce(F.col("highest_severity").isin("critical", "high"), F.lit(False)),
    })


def with_severity(agents: DataFrame, findings: DataFrame) -> DataFrame:
    return agents.join(highest_severity(findings).withColumnRenamed("agent_id", "id"), "id", "left")


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Report order: most exposed first. With *k*, a top-k that never sorts the whole table."""
    ordered = scored.orderBy(F.desc("exposure_score"), "path", "symbol")
    return ordered.limit(k) if k else ordered


def ranked_findings(findings: DataFrame, k: int | None = None) -> DataFrame:
    ordered = findings.orderBy(F.desc(L.severity_rank(F.col("severity"))), "path", "line", "rule_id")
    return ordered.limit(k) if k else ordered


def registry_summary(files: DataFrame, agents: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: the summary block of a registry."""
    parts = [
        files.agg(F.count(F.lit(1)).alias("files_scanned")),
        agents.agg(F.count(F.lit(1)).alias("agent_candidates"), F.count_if(F.col("confidence") == "high").alias("high_confidence")),
        agents.select(F.explode("integrations").alias("i")).agg(F.count_distinct("i").alias("integrations")),
        findings.agg(
            *[F.count_if(~F.col("suppressed") & (F.col("severity") == s)).alias(f"n_{s}") for s in reversed(fv.SEVERITIES)],
            *[F.count_if(~F.col("suppressed") & F.col("is_new") & (F.col("severity") == s)).alias(f"new_{s}") for s in reversed(fv.SEVERITIES)],
            F.count_if("suppressed").alias("suppressed_findings")),
    ]
    return side_by_side(parts)
