"""Result tables and documents: SARIF rows, summary, registry, graph, with checks before a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.functions.tables import side_by_side


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row per unsuppressed finding. Needs ``dimensions``."""
    return findings.where(~F.col("suppressed")).select(
        F.col("rule_id").alias("rule"),
        F.when(F.col("gate_eligible"), "error").otherwise(L.mapped(F.col("severity"), fv.SARIF_LEVEL, "note")).alias("level"),
        F.col("title").alias("message"), F.col("path").alias("uri"), F.greatest(F.lit(1), "line").alias("start_line"),
        F.greatest(F.lit(1), "column").alias("start_column"), "fingerprint", "dimensions",
        F.transform("dimensions", lambda d: F.concat(F.lit("dim:"), d)).alias("tags"), "confidence")


def sarif_json(findings: DataFrame) -> DataFrame:
    """The rows as SARIF result objects, one JSON text each."""
    r = sarif_results(findings)
    location = F.array(F.struct(F.struct(
        F.struct(F.col("uri")).alias("artifactLocation"),
        F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn")).alias("region")).alias("physicalLocation")))
    return r.select(F.to_json(F.struct(
        F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), location.alias("locations"),
        F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"),
        F.struct("dimensions", "tags", "confidence").alias("properties"))).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The rules that occur, with title, category and risk-list tags."""
    used = findings.select("rule_id").distinct()
    risk = L.mapped(F.col("rule_id"), {r: "owasp-" + v[0].lower() for r, v in fv.RISK_LIST.items()})
    return used.select(
        "rule_id", L.mapped(F.col("rule_id"), {r: v[0] for r, v in fv.RULES.items()}).alias("title"),
        F.array_compact(F.array(F.lit("security"), L.mapped(F.col("rule_id"), {r: v[1] for r, v in fv.RULES.items()}), risk)).alias("tags"))


def summary_table(scored_agents: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: candidates, high confidence, high exposure, new and existing critical, suppressed."""
    critical = ~F.col("suppressed") & (F.col("severity") == "critical")
    return side_by_side([
        scored_agents.agg(
            F.count(F.lit(1)).alias("agents"), F.count_if(F.col("confidence") == "high").alias("high_confidence"),
            F.count_if("is_high_exposure").alias("high_exposure")),
        findings.agg(
            F.count_if(critical & F.col("is_new")).alias("new_critical"), F.count_if(critical & ~F.col("is_new")).alias("existing_critical"),
            F.count_if("suppressed").alias("suppressed")),
    ])


class InvalidDocument(ValueError):
    """Rows that must not be written."""


def violations(agents: DataFrame, findings: DataFrame) -> DataFrame:
    """(kind, path): agents without id or path, and paths that are not relative."""
    absolute = F.col("path").startswith("/") | F.col("path").contains(":\\")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    a = agents.where(empty("id") | empty("path") | absolute).select(F.lit("agent").alias("kind"), "path")
    return a.unionByName(findings.where(empty("path") | absolute).select(F.lit("finding").alias("kind"), "path"))


def write_registry(agents: DataFrame, agent_findings: DataFrame, folder: str) -> None:
    """Agents with their findings nested and sorted, one JSON object per line; null fields are omitted.

    Findings of one agent are those of one source file, whose size is capped on listing. The
    flat findings table goes next to it, partitioned by rule.
    """
    bad = violations(agents, agent_findings).take(1)
    if bad:
        raise InvalidDocument(f"{bad[0]['kind']} with a missing or absolute path: {bad[0]['path']!r}")
    row = F.struct("line", "rule_id", "fingerprint", *[
        c for c in agent_findings.columns if c not in ("line", "rule_id", "fingerprint", "agent_id")])
    nested = agent_findings.groupBy(F.col("agent_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("findings"))
    agents.join(nested, "id", "left").write.mode("overwrite").json(f"{folder}/agents")
    agent_findings.write.mode("overwrite").partitionBy("rule_id").parquet(f"{folder}/findings")


def graph_json(nodes: DataFrame, edges: DataFrame, severities: DataFrame) -> DataFrame:
    """Nodes and edges as JSON texts; ``observed`` appears only when true."""
    n = nodes.join(severities, "id", "left").select(F.lit("node").alias("kind"), F.to_json(F.struct(
        "id", "type", "label", "display_severity", "path", "symbol")).alias("value"))
    observed = F.when(F.col("observed"), F.lit(True)) if "observed" in edges.columns else F.lit(None).cast("boolean")
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(
        "source", "target", F.col("kind").alias("kind"), "provenance", "max_severity", "weight", observed.alias("observed"))).alias("value"))
    return n.unionByName(e)


def write_with_header(table: DataFrame, folder: str, schema_name: str, generated_at: str | None = None) -> None:
    """A result table plus a one-row header; the clock appears in the header only."""
    table.write.mode("overwrite").parquet(f"{folder}/rows")
    table.sparkSession.range(1).select(
        F.lit(schema_name).alias("schema"), F.lit(generated_at).cast("string").alias("generated_at")).write.mode("overwrite").json(f"{folder}/header")
