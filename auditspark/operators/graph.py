"""The property graph of agents, tools and resources, as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.functions.tables import union
from auditspark.session import cut_lineage


def slug(value: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "node").otherwise(s)


def capability_label(capability: Column) -> Column:
    plain = F.replace(capability, F.lit("_"), F.lit(" "))
    plain = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.expr("substring(replace(capability, '_', ' '), 2)")))
    return F.coalesce(L.mapped(capability, fv.CAPABILITY_LABELS), plain)


def _categories_of_capability() -> dict[str, list[str]]:
    out = {}
    for cap, kind in fv.EDGE_KIND.items():
        cats = []
        if cap in ("database_read", "database_write"):
            cats.append("database")
        if cap in ("code_execution", "shell_execution"):
            cats.append("exec")
        if kind == "network":
            cats.append("network")
        if cap in fv.HIGH_IMPACT_CAPABILITIES:
            cats.append("high-impact")
        out[cap] = cats
    return out


EDGE_RULES = {
    "provider": fv.PROVIDER_EDGE_RULES, "tool": fv.TOOL_EDGE_RULES, "network": fv.NETWORK_EDGE_RULES,
    "database": fv.DATABASE_EDGE_RULES, "exec": fv.EXEC_EDGE_RULES, "high-impact": fv.HIGH_IMPACT_EDGE_RULES,
}


def _links(agents: DataFrame) -> DataFrame:
    """(source, target, kind, label, weight, categories): one row per listed tool or capability."""
    weight = (F.coalesce(F.element_at("call_sites", F.col("v")), F.lit(1)) if "call_sites" in agents.columns else F.lit(1)).cast("int")
    tools = agents.select("*", F.explode("integrations").alias("v")).select(
        F.col("id").alias("source"), F.concat(F.lit("tool_"), slug(F.col("v"))).alias("target"), F.lit("tool_call").alias("kind"),
        F.col("v").alias("label"), weight.alias("weight"), L.string_array(["tool"]).alias("categories"))
    providers = agents.select("id", F.explode("providers").alias("v")).select(
        F.col("id").alias("source"), F.concat(F.lit("tool_"), slug(F.col("v"))).alias("target"), F.lit("tool_call").alias("kind"),
        F.col("v").alias("label"), F.lit(1).alias("weight"), L.string_array(["provider"]).alias("categories"))
    cats = L.mapped(F.col("capability"), _categories_of_capability(), [])
    resources = (
        agents.select("id", F.explode("capabilities").alias("capability")).where(F.col("capability").isin(list(fv.EDGE_KIND)))
        .select(F.col("id").alias("source"), F.concat(F.lit("resource_"), "capability").alias("target"),
                L.mapped(F.col("capability"), fv.EDGE_KIND).alias("kind"), capability_label(F.col("capability")).alias("label"),
                F.lit(1).alias("weight"), cats.alias("categories")))
    return union([tools, providers, resources])


def _by_category(findings: DataFrame) -> DataFrame:
    cats = F.array_compact(F.array(*[
        F.when(F.col("rule_id").isin(rules), F.lit(name)) for name, rules in EDGE_RULES.items()]))
    return findings.select(
        F.col("agent_id").alias("source"), "rule_id", "path", "line", "severity", F.explode(cats).alias("category"))


def edges(agents: DataFrame, findings: DataFrame) -> DataFrame:
    """Static edges with their worst explaining finding.

    Findings shrink to one row per agent and category before they meet the edges, so no pair of
    a finding and an edge is ever written out.
    """
    worst = _by_category(findings).groupBy("source", "category").agg(
        F.max(L.severity_rank(F.col("severity"))).alias("rank"))
    links = _links(agents).select("source", "target", "kind", "weight", F.explode_outer("categories").alias("category"))
    return (
        links.join(worst, ["source", "category"], "left")
        .groupBy("source", "target", "kind").agg(F.max("rank").alias("rank"), F.max("weight").alias("weight"))
        .select("source", "target", "kind", L.severity(F.col("rank")).alias("max_severity"), "weight",
                F.lit("declared").alias("provenance")))


def edge_findings(agents: DataFrame, findings: DataFrame) -> DataFrame:
    """(source, target, kind, rule_id, path, line, severity): the findings that explain an edge."""
    links = _links(agents).select("source", "target", "kind", F.explode("categories").alias("category"))
    return links.join(_by_category(findings), ["source", "category"]).select(
        "source", "target", "kind", "rule_id", "path", "line", "severity").dropDuplicates(
        ["source", "target", "kind", "rule_id", "path", "line"])


def nodes(agents: DataFrame) -> DataFrame:
    """Agents plus every tool and resource any of them reaches; shared ones appear once."""
    own = agents.select(
        "id", F.when(F.array_contains("frameworks", "mcp"), "mcp_server").otherwise("agent").alias("type"),
        F.col("name").alias("label"), "path", "symbol",
        F.col("highest_severity").alias("worst_severity") if "highest_severity" in agents.columns
        else F.lit(None).cast("string").alias("worst_severity"))
    shared = _links(agents).groupBy(F.col("target").alias("id")).agg(F.min("label").alias("label")).select(
        "id", F.when(F.col("id").startswith("tool_"), "tool").otherwise("resource").alias("type"), "label",
        *[F.lit(None).cast("string").alias(c) for c in ("path", "symbol", "worst_severity")])
    return own.unionByName(shared)


def node_severities(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Display severity: the worst of the node's own and of every edge touching it."""
    rank = L.severity_rank
    touching = edges_.select(F.explode(F.array("source", "target")).alias("id"), rank(F.col("max_severity")).alias("rank"))
    own = nodes_.select("id", rank(F.col("worst_severity")).alias("rank"))
    return own.unionByName(touching).groupBy("id").agg(F.max("rank").alias("rank")).select(
        "id", L.severity(F.col("rank")).alias("display_severity"))


def overlay_runtime(edges_: DataFrame, nodes_: DataFrame, agent_ids: DataFrame, counts: DataFrame,
                    delegations: DataFrame) -> DataFrame:
    """Static edges seen in traces gain ``observed``; unseen-before reach becomes new edges.

    ``counts`` is the long value table of spans, ``delegations`` is (agent_id, to_agent_id). Both
    sides meet in one aggregation by edge key instead of an outer join.
    """
    known = agent_ids.select(F.col("id").alias("agent_id"))
    seen = counts.join(known, "agent_id", "left_semi")
    caps = seen.where((F.col("dim") == "capability") & F.col("value").isin(list(fv.EDGE_KIND))).select(
        F.col("agent_id").alias("source"), F.concat(F.lit("resource_"), "value").alias("target"),
        L.mapped(F.col("value"), fv.EDGE_KIND).alias("kind"))
    tools = seen.where(F.col("dim") == "integration").select(
        F.col("agent_id").alias("source"), F.concat(F.lit("tool_"), slug(F.col("value"))).alias("target"), F.lit("tool_call").alias("kind"))
    # a delegation is drawn only between nodes the static graph or the observed reach has
    reached = nodes_.select("id").unionByName(caps.select(F.col("target").alias("id"))).unionByName(
        tools.select(F.col("target").alias("id"))).distinct()
    handed = (
        delegations.join(known, "agent_id", "left_semi").join(reached.withColumnRenamed("id", "to_agent_id"), "to_agent_id", "left_semi")
        .select(F.col("agent_id").alias("source"), F.col("to_agent_id").alias("target"), F.lit("delegates").alias("kind")))
    observed = union([caps, tools, handed]).select("source", "target", "kind", F.lit(None).cast("int").alias("rank"),
                                                    F.lit(None).cast("int").alias("weight"), F.lit(0).alias("static"), F.lit(1).alias("runtime"))
    static = edges_.select("source", "target", "kind", L.severity_rank(F.col("max_severity")).alias("rank"), "weight",
                           F.lit(1).alias("static"), F.lit(0).alias("runtime"))
    merged = static.unionByName(observed).groupBy("source", "target", "kind").agg(
        F.max("rank").alias("rank"), F.max("weight").alias("weight"), F.max("static").alias("static"), F.max("runtime").alias("runtime"))
    return merged.select(
        "source", "target", "kind", L.severity(F.col("rank")).alias("max_severity"), F.coalesce("weight", F.lit(1)).alias("weight"),
        F.when(F.col("static") == 1, "declared").otherwise("observed").alias("provenance"),
        ((F.col("static") == 1) & (F.col("runtime") == 1) & (F.col("kind") != "delegates")).alias("observed"))


def focus(edges_: DataFrame, center: str) -> DataFrame:
    """Edges among a node and its direct neighbours."""
    near = edges_.where((F.col("source") == center) | (F.col("target") == center)).select(
        F.explode(F.array("source", "target")).alias("id")).distinct()
    return (edges_.join(near.withColumnRenamed("id", "source"), "source", "left_semi")
            .join(near.withColumnRenamed("id", "target"), "target", "left_semi"))


def reach(edges_: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, hops): every node that the seeds reach along edge direction, with the fewest hops.

    Breadth-first: each round joins only the newest frontier with the edges and drops what was
    seen, so every node is expanded once. The lineage is cut each round.
    """
    links = cut_lineage(edges_.select("source", "target").distinct())
    seen = cut_lineage(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    hop = 0
    while not frontier.isEmpty():
        hop += 1
        step = (
            links.join(frontier.select(F.col("id").alias("source")), "source", "left_semi")
            .select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti"))
        frontier = cut_lineage(step.withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen
