"""Every registered query: (spark, sf_dir) -> DataFrame over the whole bench tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.functions import text as X
from auditspark.operators import (assurance, candidates, contradictions, dimensions, drift, exposure, features, findings,
                                  flow, graph, line_rules, runtime_merge, runtime_rules, snapshot, supply_chain)
from auditspark.operators import spans as S
from auditspark.plans import corpus_scan
from auditspark.session import cut_lineage, dealt, spread, stored
from auditspark.settings import Settings
from auditspark.sinks import tables as sinks
from auditspark.sources import code_corpus, declarations, derived, traces
from auditspark.streaming import spans as streams

LOW = Settings(min_count=5, ratio_threshold=2.0)
SUPPRESS = Settings(runtime_suppress=("RT002:*", "RT003:a10", "RT001:a20"))
GATE = Settings(fail_on="high", fail_on_new="medium", gate_additional_rules=("AI001",))
AS_OF = "1997-01-01"

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def _joined(col) -> F.Column:
    return F.array_join(col, ",")


# ------------------------------------------------------------------ spans

def _facts(spark, d, now=None) -> S.Facts:
    """The facts of all spans: everything below is derived from them, and spans never meet the registry."""
    return S.facts(derived.spans(spark, d), derived.locate, now)


def _given(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("agent_id").isNotNull())


def _behaviours(spark, d):
    """(current window, baseline window) of agents, from one table of facts."""
    facts = _facts(spark, d, derived.is_now()).given().stored()
    return drift.Behaviour.of(facts.window(True)), drift.Behaviour.of(facts.window(False))


def _declared(registry):
    return declarations.valid_declared(registry.declared)


def _static(registry):
    return registry.agents.select(F.col("id").alias("agent_id"), F.explode("capabilities").alias("capability"))


def _stamped(summary: DataFrame) -> list:
    return [S.iso(F.col("first_at")).alias("first_ts"), S.iso(F.col("last_at")).alias("last_ts")]


@query
def span_summary(spark, d):
    s = S.summarize(_facts(spark, d).given())
    return s.select("agent_id", "span_count", *[f"n_{k}" for k in fv.SPAN_KINDS], "errors", "error_rate", "high_impact_actions",
                    "high_impact_approved", "approval_rate", "evidence_quality", *_stamped(s), "max_amount")


@query
def span_value_counts(spark, d):
    return S.value_counts(_facts(spark, d).given())


@query
def span_window_totals(spark, d):
    facts = _facts(spark, d).stored()
    w = S.window_totals(facts).select(F.lit("*").alias("agent_id"), F.lit("spans").alias("currency"), F.col("span_count").cast("double").alias("total"),
                                      S.iso(F.col("start_at")).alias("start_ts"), S.iso(F.col("end_at")).alias("end_ts"))
    none = F.lit(None).cast("string")
    return w.unionByName(S.amount_totals(facts.given()).select("agent_id", "currency", "total", none.alias("start_ts"), none.alias("end_ts")))


@query
def first_unapproved_ref(spark, d):
    facts = _facts(spark, d).given().stored()
    un = S.first_unapproved(facts).select("agent_id", F.lit("unapproved").alias("ref"), "file", "line", "span_id")
    caps = S.first_capability_spans(facts).select("agent_id", F.col("capability").alias("ref"), "file", "line", "span_id")
    return un.unionByName(caps)


@query
def max_amount_ref(spark, d):
    return S.max_amount_spans(_facts(spark, d).given())


@query
def span_correlation(spark, d):
    """Spans of every tenth agent meet a registry that doesn't have it."""
    c = S.classify(_facts(spark, d).stored(), derived.registry(spark, d).known)
    return c.rows("span").groupBy("bucket", "key", "reason").agg(F.sum("n").alias("span_count"))


@query
def unmatched_summaries(spark, d):
    """The whole summary of spans without a registry agent; every tenth agent is left out of the registry for it."""
    u = S.unmatched(S.classify(_facts(spark, d).stored(), derived.registry(spark, d).known))
    return u.select("key", "reason", "span_count", "n_action", "n_tool_call", "errors", "error_rate", "high_impact_actions", "high_impact_approved",
                    "max_amount", "evidence_quality", *_stamped(u))


@query
def suggested_matches(spark, d):
    """Proposals among the nine agents in ten that the registry has here."""
    agents = derived.registry(spark, d).known
    return S.suggested_matches(S.unmatched(S.classify(_facts(spark, d).stored(), agents)), agents)


@query
def agents_without_spans(spark, d):
    return S.without_evidence(derived.registry_agents(spark, d), _facts(spark, d).given().rows("span").select("agent_id").distinct())


@query
def span_delegations(spark, d):
    return S.delegations(_facts(spark, d).given())


@query
def approvals_verified(spark, d):
    return S.approvals_verified(_given(derived.spans(spark, d)))


# ------------------------------------------------------------------ drift

@query
def drift_new_values(spark, d):
    now, base = _behaviours(spark, d)
    return drift.new_values(now, base, _static(derived.registry(spark, d))).select("class", "kind", "agent_id", "category", "high_impact")


@query
def drift_frequency_shift(spark, d):
    now, base = _behaviours(spark, d)
    return drift.frequency_shifts(now, base, LOW).select("agent_id", "field", "category", "rate_now", "rate_baseline", "ratio", "count_now")


@query
def drift_approval_drop(spark, d):
    now, base = _behaviours(spark, d)
    return drift.approval_drops(now, base).select("agent_id", "rate_now", "rate_baseline")


@query
def drift_amount_limits(spark, d):
    now, _ = _behaviours(spark, d)
    return drift.amount_breaches(now, _declared(derived.registry(spark, d))).select("kind", "agent_id", "observed", "declared", "currency")


@query
def drift_gone(spark, d):
    now, base = _behaviours(spark, d)
    return drift.gone_capabilities(now, base).select("agent_id", "category")


@query
def drift_summary(spark, d):
    now, base = _behaviours(spark, d)
    registry = derived.registry(spark, d)
    return drift.summarize_events(drift.compute_drift(now, base, _static(registry), _declared(registry), LOW))


# ------------------------------------------------------------------ runtime contradictions and merge

def _runtime(spark, d, settings=Settings()):
    """(registry, facts of spans with an agent, runtime contradictions)."""
    registry, facts = derived.registry(spark, d), _facts(spark, d).stored()
    subjects = runtime_rules.subjects(registry.agents, _declared(registry))
    return registry, facts, runtime_rules.detect(subjects, facts.given(), settings)


@query
def rt_contradictions(spark, d):
    return _runtime(spark, d, SUPPRESS)[2].select(
        "rule_id", "agent_id", "path", "line", "severity", "confidence", "snippet", "fingerprint", "suppressed", "ref_span", "declared_key")


@query
def merge_liveness(spark, d):
    e = runtime_merge.enrich(derived.registry_agents(spark, d), S.summarize(_facts(spark, d).given()))
    return e.select("id", "liveness_state", "span_count", "approval_rate", "evidence_quality")


@query
def merge_coverage(spark, d):
    """The registry lacks every tenth agent, so that spans without one exist."""
    registry, facts = derived.registry(spark, d), _facts(spark, d).stored()
    rt = runtime_rules.detect(runtime_rules.subjects(registry.known, _declared(registry)), facts.given())
    row = runtime_merge.coverage(registry.known, S.summarize(facts.given()), S.classify(facts, registry.known), rt)
    return row.select("agents_total", "agents_covered", "span_count", "unmatched_agents", "rt_findings", S.iso(F.col("start_at")).alias("start_ts"),
                      S.iso(F.col("end_at")).alias("end_ts"), "quality_content", "quality_mixed", "quality_redacted")


def _scored(spark, d):
    registry = derived.registry(spark, d)
    return registry, dimensions.assess(registry.agents, registry.findings)


def _overlaid(spark, d):
    registry, assessment = _scored(spark, d)
    facts = _facts(spark, d).given().stored()
    return dimensions.overlay_runtime(assessment, S.summarize(facts), dimensions.model_stats(S.value_counts(facts, ["model"])), _declared(registry))


@query
def runtime_dimensions(spark, d):
    return _overlaid(spark, d).where(F.col("dimension").isin(fv.UPGRADEABLE_DIMENSIONS)).select(
        "agent_id", "dimension", "assessability", "exposure", "window_spans")


@query
def runtime_dimension_rollup(spark, d):
    return dimensions.rollup(_overlaid(spark, d))


# ------------------------------------------------------------------ scoring

@query
def dimension_scores(spark, d):
    return _scored(spark, d)[1].select("agent_id", "dimension", "assessability", "score", "exposure", "n_find", "n_cap", "n_ctrl")


@query
def dimension_rollup(spark, d):
    return dimensions.rollup(_scored(spark, d)[1])


@query
def dimension_group_rollup(spark, d):
    return dimensions.group_rollup(_scored(spark, d)[1])


@query
def unclassified_findings(spark, d):
    registry, _, found = _runtime(spark, d)
    rt = found.select("rule_id", "agent_id", "fingerprint", "suppressed", F.lit(None).cast("string").alias("variant"))
    both = registry.findings.select(*rt.columns).unionByName(rt)
    return dimensions.unclassified(both).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query
def exposure_scores(spark, d):
    registry = derived.registry(spark, d)
    agents = registry.agents
    s = exposure.score(exposure.with_severity(agents, registry.findings))
    return s.select("id", "highest_severity", "exposure_score", "exposure_tier", "is_high_exposure")


@query
def exposure_rank_topk(spark, d):
    registry = derived.registry(spark, d)
    agents = registry.agents
    s = exposure.score(exposure.with_severity(agents, registry.findings))
    return exposure.ranked(s, 25).select("id", "path", "exposure_score")


@query
def registry_summary(spark, d):
    """The summary block of a registry, with one file for each path that has an agent."""
    registry = derived.registry(spark, d)
    agents = registry.agents
    f = registry.findings.withColumn("is_new", F.col("line") % 4 == 0)
    return exposure.registry_summary(agents.select("path").distinct(), agents, f)


@query
def confidence_changes(spark, d):
    """Agents whose confidence moved one level, up for some customers and down for others."""
    base = derived.registry_agents(spark, d).select("id", "confidence")
    key = F.substring("id", 2, 12).cast("long")
    moved = L.step(F.col("confidence"), fv.CONFIDENCES, F.when(key % 4 == 0, 1).when(key % 7 == 0, -1).otherwise(0))
    return snapshot.confidence_changes(base, base.select("id", moved.alias("confidence")))


@query
def stale_approvals(spark, d):
    return snapshot.stale_approvals(_approved(spark, d, _changes(spark, d)[3]))


@query
def sarif_rules(spark, d):
    rules = sinks.sarif_rules(derived.registry_findings(derived.registry_agents(spark, d)))
    return rules.select("rule_id", "title", _joined("tags").alias("tags"))


@query
def severity_counts(spark, d):
    registry = derived.registry(spark, d)
    agents = registry.agents
    f = registry.findings.withColumn("is_new", F.col("line") % 4 == 0)
    return exposure.severity_counts(f)


@query
def gate(spark, d):
    registry = derived.registry(spark, d)
    agents = registry.agents
    f = registry.findings.withColumn("is_new", F.col("line") % 4 == 0)
    return findings.gate(f, GATE, diff_available=True)


# ------------------------------------------------------------------ graph

def _graph(spark, d):
    registry = derived.registry(spark, d)
    agents = exposure.with_severity(registry.agents, registry.findings)
    return agents, registry.findings, graph.nodes(agents), graph.edges(agents, registry.findings)


@query
def graph_nodes(spark, d):
    return _graph(spark, d)[2]


@query
def graph_edges(spark, d):
    return _graph(spark, d)[3]


@query
def graph_edge_findings(spark, d):
    agents, f, _, _ = _graph(spark, d)
    return graph.edge_findings(agents, f)


@query
def graph_node_severity(spark, d):
    _, _, nodes, edges = _graph(spark, d)
    return graph.node_severities(nodes, edges)


@query
def graph_overlay(spark, d):
    agents, _, nodes, edges = _graph(spark, d)
    facts = _facts(spark, d).given().stored()
    return graph.overlay_runtime(edges, nodes, agents, S.value_counts(facts, dims=["capability", "integration"]), S.delegations(facts))


@query
def graph_focus(spark, d):
    return graph.focus(_graph(spark, d)[3], "a0").select("source", "target", "kind")


@query
def delegation_reach(spark, d):
    edges = S.delegations(_facts(spark, d).given()).select(F.col("agent_id").alias("source"), F.col("to_agent_id").alias("target"))
    seeds = edges.join(edges.select(F.col("target").alias("source")), "source", "left_anti").select(F.col("source").alias("id"))
    return graph.reach(edges, seeds)


# ------------------------------------------------------------------ declared facts

@query
def declared_validated(spark, d):
    v = declarations.valid_declared(derived.declared(spark, d))
    return v.select("agent_id", "users", "production_status", "autonomy_intent", _joined("data_classes").alias("data_classes"),
                    F.col("economic_authority.max_per_action.amount").alias("max_per_action"))


@query
def declared_warnings(spark, d):
    return declarations.declared_warnings(derived.declared(spark, d))


@query
def decl_contradictions(spark, d):
    """The registry lacks every tenth agent and the declarations every fourth, so that stale and undeclared ids exist."""
    registry = derived.registry(spark, d)
    return contradictions.detect(registry.known, _declared(registry), derived.registry_findings(registry.known)).select(
        "rule_id", "agent_id", "path", "line", "severity", "snippet", "fingerprint", "declared_key")


@query
def assurance_long(spark, d):
    registry = derived.registry(spark, d)
    summary = S.summarize(_facts(spark, d).given())
    packet = assurance.agent_areas(registry.agents, registry.findings, _declared(registry), dimensions.assess(registry.agents, registry.findings), summary)
    return packet.select("area", "agent_id", "field", "status")


@query
def assurance_contradictions(spark, d):
    """As decl_contradictions, over a registry that lacks every tenth agent."""
    registry, facts = derived.registry(spark, d), _facts(spark, d).given().stored()
    decl = contradictions.detect(registry.known, _declared(registry), derived.registry_findings(registry.known))
    rt = runtime_rules.detect(runtime_rules.subjects(registry.known, _declared(registry)), facts, SUPPRESS)
    both = decl.select("rule_id", "path", "line", "severity", "suppressed").unionByName(rt.select("rule_id", "path", "line", "severity", "suppressed"))
    return assurance.open_contradictions(both)


# ------------------------------------------------------------------ snapshot diff

def _snapshots(spark, d):
    """Two registries from all order lines: customers by priority are agents, brands capabilities, types integrations.

    Lines before the cut-off are the base, all others the head; an agent without a line on one side was added or removed.
    Brand names map to capability names and types to integration names, so the high-impact and sensitive lists apply.
    """
    l = derived.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_shipdate") < F.lit("1998-05-24").cast("timestamp_ntz")).alias("is_base"))
    agent = F.col("o_custkey") * 5 + F.substring("o_orderpriority", 1, 1).cast("long") - 1
    o = derived.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("a"), agent.cast("string")).alias("agent_id"))
    p = derived.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    # all lines of an agent meet in one task, as narrow rows with the places of the names: items are distinct within it
    rows = (
        l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
        .select("agent_id", "is_base", (number % 23).alias("capability"), (F.length("p_type") * 3 + number % 4).alias("integration"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "agent_id"))
    pairs = F.array(F.struct(F.lit("capability").alias("kind"), derived.pick(derived.CAPABILITIES, F.col("capability")).alias("value")),
                    F.struct(F.lit("integration").alias("kind"), derived.pick(derived.INTEGRATIONS, F.col("integration")).alias("value")))
    items = rows.select("agent_id", "is_base", F.explode(pairs).alias("p")).select("agent_id", "is_base", "p.*").distinct()
    items = stored(items)  # a snapshot is a stored registry: built once, read by every part of a diff
    return items.where("is_base").drop("is_base"), items.where(~F.col("is_base")).drop("is_base")


def _ids(items: DataFrame) -> DataFrame:
    return items.select(F.col("agent_id").alias("id")).distinct()


def _head_agents(items: DataFrame) -> DataFrame:
    """Agents of a snapshot with their lists; each list has at most as many entries as its vocabulary."""
    sets = items.groupBy(F.col("agent_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "capability", F.col("value")))).alias("capabilities"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "integration", F.col("value")))).alias("integrations"))
    return sets.withColumns({"name": F.concat(F.lit("n"), "id"), "path": F.concat(F.lit("svc/"), "id")})


def _approvals(spark, d):
    """Two records for some (agent, capability) pairs: expired ones, changed ones and good ones."""
    c = F.col("c_custkey")
    caps = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(i).alias("i")) for i, v in enumerate(derived.CAPABILITIES) if i % 3 == 0])
    rows = derived.table(spark, d, "customer").select(c.alias("c"), F.explode(caps).alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    key = F.col("c") + F.col("v.i") + F.col("r")
    return rows.select(
        (F.col("c") * 100 + F.col("v.i") * 2 + F.col("r")).alias("ord"), F.concat(F.lit("a"), "c").alias("agent_id"),
        F.lit("capability").alias("kind"), F.col("v.value").alias("value"),
        F.when(key % 5 == 0, "feedfacefeed").alias("evidence_fingerprint"),
        F.when(key % 4 == 0, "1996-01-01").when(key % 4 == 1, "2099-12-31").when(key % 4 == 2, "soon").alias("expires"))


@query
def snapshot_diff_agents(spark, d):
    base, head = _snapshots(spark, d)
    m = snapshot.match_agents(_ids(base), _ids(head))
    added = snapshot.added_agents(_head_agents(head), m).select("agent_id", F.lit("added").alias("status"), "drift", "reason")
    named = lambda df: df.select("id", F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("svc/"), "id").alias("path"))
    removed = snapshot.removed_agents(named(_ids(base)), m).select("agent_id", F.lit("removed").alias("status"), "drift", F.lit(None).cast("string").alias("reason"))
    return added.unionByName(removed)


def _changes(spark, d):
    """Both snapshots, their agents and the changes of items, the last two stored: several parts of a diff read them."""
    base, head = _snapshots(spark, d)
    m = stored(snapshot.match_agents(_ids(base), _ids(head)))
    return base, head, m, stored(snapshot.item_changes(base, head, m.where(F.col("status") == "common")))


@query
def snapshot_diff_items(spark, d):
    return _changes(spark, d)[3]


def _approved(spark, d, items):
    fingerprints = items.select("agent_id").distinct().withColumn("fingerprint", F.substring(F.sha2("agent_id", 256), 1, 12))
    return snapshot.with_approval(items.where(F.col("change") == "added"), _approvals(spark, d), fingerprints, AS_OF)


@query
def snapshot_diff_approved(spark, d):
    return _approved(spark, d, _changes(spark, d)[3]).select("agent_id", "kind", "value", "drift", "approved", "stale_reason")


@query
def snapshot_diff_summary(spark, d):
    base, head, m, items = _changes(spark, d)
    new = snapshot.added_agents(_head_agents(head), m).withColumns({"kind": F.lit("new-agent"), "value": F.col("name")})
    prints = new.select("agent_id", F.substring(F.sha2("agent_id", 256), 1, 12).alias("fingerprint"))
    added = snapshot.with_approval(new, _approvals(spark, d), prints, AS_OF)
    f_base, f_head = _finding_snapshots(spark, d)
    common = m.where(F.col("status") == "common")
    fc = snapshot.finding_changes(f_base, f_head, common)
    agents = derived.registry_agents(spark, d)
    dims = snapshot.dimension_changes(dimensions.assess(agents, f_base), dimensions.assess(agents, f_head), common)
    none = items.limit(0)  # agents of order lines have no confidence
    changed = snapshot.changed_agents(items, fc, dims, none.select("agent_id", F.lit("").alias("drift")))
    return snapshot.summarize(m, _approved(spark, d, items), added, changed, items, fc)


def _finding_snapshots(spark, d):
    """Findings before and after: those of every registry agent, with some appearing and some going."""
    registry = derived.registry(spark, d)
    agents = registry.agents
    f = registry.findings
    key = F.col("line") * 7 + F.length("rule_id") * 3
    return f.where(key % 5 != 0), f.where(key % 5 != 1)


@query
def snapshot_diff_findings(spark, d):
    base, head = _finding_snapshots(spark, d)
    ids = derived.registry_agents(spark, d).select("id")
    return snapshot.finding_changes(base, head, ids)


@query
def snapshot_diff_dimensions(spark, d):
    agents = derived.registry_agents(spark, d)
    base, head = _finding_snapshots(spark, d)
    return snapshot.dimension_changes(dimensions.assess(agents, base), dimensions.assess(agents, head), agents)


def _evidence_sets(spark, d):
    """Brands and sizes per supplier, before and from the cut-off on, as evidence hashes of base and head agents."""
    l = derived.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    p = derived.table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", (F.col("p_size") % 8).cast("string")).alias("kind"))
    rows = l.join(p, l.l_partkey == p.p_partkey).select(
        "l_suppkey", "kind", F.when(F.col("l_shipdate") < F.lit("1998-05-24").cast("timestamp_ntz"), "b").otherwise("h").alias("side")).distinct()
    sets = cut_lineage(rows.groupBy("side", "l_suppkey").agg(F.array_sort(F.collect_set("kind")).alias("hashes")))
    ids = F.concat("side", F.lpad(F.col("l_suppkey").cast("string"), 8, "0"))
    return (sets.where(F.col("side") == "b").select(ids.alias("id"), "hashes"), sets.where(F.col("side") == "h").select(ids.alias("id"), "hashes"))


@query
def rename_best_candidate(spark, d):
    base, head = _evidence_sets(spark, d)
    return snapshot.best_candidates(base, head)


@query
def rename_assignment(spark, d):
    base, head = _evidence_sets(spark, d)
    return snapshot.renames(base, head)


@query
def changelog(spark, d):
    base, head, m, items = _changes(spark, d)
    f_base, f_head = _finding_snapshots(spark, d)
    named = _ids(base).select("id", F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("svc/"), "id").alias("path"))
    return snapshot.changelog(items, snapshot.added_agents(_head_agents(head), m), snapshot.removed_agents(named, m),
                              snapshot.finding_changes(f_base, f_head, m.where(F.col("status") == "common"))).select(
        "section", "agent_id", "change", "drift")


# ------------------------------------------------------------------ documents

def _documents(spark, d):
    docs = spread(derived.table(spark, d, "documents"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), F.lit(False).alias("is_testlike"),
                       F.octet_length("text").cast("long").alias("length"), F.col("text").alias("content"))


# patterns of personal data and license lines the documents hold
DOCUMENT_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "token": r"\b[0-9a-f]{40}\b",
    "card": r"\b[0-9]{16}\b",
    "license": r"(?i)licen[sc]e",
}


@query
def doc_rule_scan(spark, d):
    from auditspark.sources.corpus import lines

    rows = lines(_documents(spark, d))
    t = F.col("text")
    hits = F.array_compact(F.array(*[
        F.when(t.rlike("(?d)" + p), F.struct(F.lit(name).alias("rule"), F.regexp_instr(t, F.lit("(?d)" + p)).alias("column")))
        for name, p in DOCUMENT_RULES.items()]))
    return rows.select("path", "line", F.explode(hits).alias("h")).select("path", "line", "h.rule", "h.column")


def _tokens(spark, d):
    from auditspark.sources.corpus import lines

    rows = lines(_documents(spark, d)).where(F.col("text").rlike(DOCUMENT_RULES["token"]))
    return rows.select("path", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(DOCUMENT_RULES["token"]), F.lit(0))).alias("nth", "token"))


@query
def doc_secret_entropy(spark, d):
    t = _tokens(spark, d)
    comment, confidence = X.matches(F.col("text"), fv.COMMENT_LINE), line_rules.secret_confidence
    return t.select("path", "line", "nth", L.half_even(X.entropy(F.col("token")), 6).alias("entropy"),
                    confidence(F.col("token"), F.col("text"), comment, F.lit(False)).alias("confidence"))


@query
def doc_redacted(spark, d):
    t = _tokens(spark, d)
    return t.select("path", "line", "nth", X.redact(F.col("text"), DOCUMENT_RULES["token"]).alias("shown"))


@query
def doc_fingerprints(spark, d):
    from pyspark.sql.window import Window

    from auditspark.sources.corpus import lines

    rows = lines(_documents(spark, d)).where(F.col("text").rlike(DOCUMENT_RULES["license"]))
    shown = rows.select("path", "line", F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")).alias("snippet"))
    nth = F.row_number().over(Window.partitionBy("path", "snippet").orderBy("line")) - 1
    numbered = shown.withColumn("nth", nth.cast("long"))
    context = F.when(F.col("nth") == 0, F.col("snippet")).otherwise(F.concat("snippet", F.lit("#"), F.col("nth").cast("string")))
    return numbered.select("path", "line", "nth", X.finding_fingerprint(F.lit("LIC001"), F.col("path"), context).alias("fingerprint"))


@query
def insecure_urls(spark, d):
    pages = derived.table(spark, d, "pages").select("page_id", "url")
    host = line_rules.insecure_host(F.col("url"))
    return pages.select("page_id", host.alias("host")).where(F.col("host").isNotNull())


# ------------------------------------------------------------------ the derived code corpus

@query
def corpus_files(spark, d):
    from auditspark.sources.corpus import listed

    files, skipped = listed(code_corpus.raw_files(spark, d))
    kept = files.select("path", "language", "is_testlike", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(skipped.select("path", F.lit(None).cast("string").alias("language"), F.lit(None).cast("boolean").alias("is_testlike"), "reason"))


@query
def code_line_findings(spark, d):
    return line_rules.scan(code_corpus.files(spark, d)).select(
        "path", "line", "column", "rule_id", "severity", "confidence", "snippet", "fingerprint")


@query
def code_supply_chain(spark, d):
    return supply_chain.detect(code_corpus.files(spark, d)).select("path", "line", "variant", "severity", "confidence", "snippet", "fingerprint")


@query
def code_features(spark, d):
    f = features.file_features(code_corpus.files(spark, d))
    sites = F.array_join(F.transform(F.map_entries("call_sites"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return f.select("path", _joined("providers").alias("providers"), _joined("capabilities").alias("capabilities"),
                    _joined("permission_tags").alias("permission_tags"), sites.alias("call_sites"), _joined("controls").alias("controls"))


@query
def text_rule_scan(spark, d):
    """The line rules over documents, web pages and conversations."""
    return line_rules.scan(derived.texts(spark, d)).select(
        "path", "line", "column", "rule_id", "severity", "confidence", "snippet", "fingerprint")


@query
def text_features(spark, d):
    """Features of documents, web pages and conversations that have any."""
    f = features.file_features(derived.texts(spark, d))
    some = F.size(F.concat("providers", "capabilities", "permission_tags", "integrations", "controls")) > 0
    return f.where(some).select("path", _joined("providers").alias("providers"), _joined("capabilities").alias("capabilities"),
                                _joined("permission_tags").alias("permission_tags"), _joined(F.array_sort("integrations")).alias("integrations"), _joined("controls").alias("controls"))


@query
def trace_spans(spark, d):
    """Spans read back from lines of JSON, without those of files of a later major version."""
    return traces.spans(traces.parse_lines(derived.trace_lines(spark, d))).select(
        "trace_file", "trace_line", "kind", "span_id", "agent_id", "status", "capability", F.col("amount.amount").alias("amount"), "approval_span_id",
        F.unix_millis("start_at").alias("start_ms"))


@query
def trace_read_stats(spark, d):
    return traces.read_stats(traces.parse_lines(derived.trace_lines(spark, d)))


@query
def trace_rejected(spark, d):
    return traces.rejected_from(traces.parse_lines(derived.trace_lines(spark, d)))


@query
def corpus_controls(spark, d):
    return features.corpus_controls(code_corpus.files(spark, d))


@query
def code_candidates(spark, d):
    c = candidates.candidates(candidates.scored_files(code_corpus.files(spark, d)))
    return c.select("id", "symbol", "path", "confidence", "detection_score", _joined("frameworks").alias("frameworks"), "line")


@query
def code_prompts(spark, d):
    files = code_corpus.files(spark, d)
    c = candidates.candidates(candidates.scored_files(files))
    return candidates.prompts(c, features.corpus_controls(files)).select("agent_id", "path", "line", "rule_id", "severity", "snippet", "fingerprint")


def _core(spark, d):
    files = code_corpus.files(spark, d)
    return files, corpus_scan.normal(line_rules.scan(files)).unionByName(corpus_scan.normal(supply_chain.detect(files)))


@query
def suppressions_applied(spark, d):
    from auditspark.sources.corpus import lines

    files, found = _core(spark, d)
    # few rows that two joins read: files without the marker are not cut into lines
    marked = files.where(F.col("content").contains(findings.DIRECTIVE_MARKER))
    return findings.apply_suppressions(found, cut_lineage(findings.directives(lines(marked)))).select(
        "path", "line", "rule_id", "fingerprint", "suppressed", "suppression_reason")


@query
def suppression_warnings(spark, d):
    from auditspark.sources.corpus import lines

    return findings.directive_warnings(findings.directives(lines(code_corpus.files(spark, d)))).select("path", "line", "rule_id", "problem")


@query
def superseded(spark, d):
    _, found = _core(spark, d)
    return findings.apply_supersedes(cut_lineage(found)).select("path", "line", "rule_id", "fingerprint")


@query
def flow_facts(spark, d):
    return flow.facts(code_corpus.files(spark, d), stored=False).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))


@query
def flow_findings(spark, d):
    files = code_corpus.files(spark, d)
    return flow.scan(files, flow.facts(files)).select(
        "path", "line", "rule_id", "variant", "severity", "confidence", "gate_eligible", "snippet",
        F.size("flow").alias("steps"), _joined("evidence_tags").alias("tags"), "fingerprint")


@query
def autonomy_ladder(spark, d):
    scan = corpus_scan.scan(code_corpus.files(spark, d))
    return scan.agents.select("id", "path", "symbol", "confidence", "autonomy_level", "deciding_signal", "deciding_line")


@query
def sarif_rows(spark, d):
    files, found = _core(spark, d)
    return sinks.sarif_results(dimensions.tag_findings(found.withColumn("suppressed", F.lit(False)))).select(
        "rule", "level", "uri", "start_line", "start_column", "fingerprint", _joined("dimensions").alias("dimensions"), "confidence")


@query
def summary_table(spark, d):
    registry = derived.registry(spark, d)
    agents = registry.agents
    f = registry.findings.withColumn("is_new", F.col("line") % 4 == 0)
    return sinks.summary_table(exposure.score(exposure.with_severity(agents, f)), f)


# ------------------------------------------------------------------ intervals, owners, authors, diffs

@query
def interval_new_findings(spark, d):
    # a split of well-compressed lines holds tens of millions of them, too many groups for one task
    l = dealt(derived.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), "l_returnflag"), "path")
    ranges = l.where(F.col("l_returnflag") != "N").groupBy("path", "l_returnflag").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line")).select("path", "start_line", "end_line")
    rows = l.select("path", "line")
    return findings.mark_new(rows, ranges).groupBy("path", "line", "is_new").agg(F.count(F.lit(1)).alias("n"))


OWNERS = [("*", ["@all"]), ("src/", ["@core", "@lead"]), ("*.ts", ["@web"]), ("/app/m1*/", ["@apps"]), ("tests/**", ["@qa"]), ("lib/core/m3/*.py", ["@lib"])]


@query
def owners_last_match(spark, d):
    paths = code_corpus.files(spark, d).select("path")
    return findings.owners(paths, OWNERS).select("path", "owner_pattern", _joined("owners").alias("owners"))


@query
def attribution(spark, d):
    l = derived.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    author = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("renovate-"), "l_suppkey")).otherwise(F.concat(F.lit("dev"), "l_suppkey"))
    commits = l.select(F.concat(F.lit("p"), "l_partkey").alias("path"), author.alias("author"),
                       F.concat(F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("-"), author).alias("hash"),
                       F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("date"))
    return findings.attribution(commits)


@query
def diff_hunks(spark, d):
    o = derived.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hunk = lambda start, count: F.concat(F.lit("@@ -1,2 +"), start.cast("string"), F.lit(","), count.cast("string"), F.lit(" @@ ctx"))
    text = F.concat_ws(
        "\n", F.lit("diff --git a/x b/x"), F.concat(F.lit("+++ b/src/f"), c), hunk(k % 90 + 1, k % 4), F.lit("+added"),
        F.concat(F.lit("@@ -9 +"), (k % 70 + 200).cast("string"), F.lit(" @@")), F.lit("+++ /dev/null"), hunk(k % 5 + 1, F.lit(3)),
        F.concat(F.lit("+++ b/lib/g"), k % 9), hunk(c % 50 + 1, c % 3 + 1))
    return findings.added_ranges(o.select(k.cast("string").alias("diff_id"), text.alias("text")))


# ------------------------------------------------------------------ streams

@query
def stream_daily_totals(spark, d):
    return streams.batch_result(streams.daily_breaches, spark, d)


@query
def stream_agent_counters(spark, d):
    return streams.batch_result(streams.hourly_counters, spark, d)


@query
def stream_redacted(spark, d):
    return streams.batch_result(streams.redacted, spark, d)


@query
def stream_sessions(spark, d):
    return streams.batch_result(streams.sessions, spark, d)


@query
def stream_approval_windows(spark, d):
    return streams.batch_result(streams.approval_windows, spark, d)
