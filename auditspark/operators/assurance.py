"""The assurance packet as one long table: area, agent, field, status, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.functions.tables import union

ROW = "struct<area:string,field:string,status:string,evidence:map<string,string>>"


def _row(area: str, field: str, status: Column, evidence: dict[str, Column] | None = None) -> Column:
    entries = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v.cast("string"))]
    shown = F.when(status != "not_provided", F.create_map(*entries)) if entries else F.lit(None)
    return F.struct(F.lit(area).alias("area"), F.lit(field).alias("field"), status.alias("status"), shown.cast("map<string,string>").alias("evidence")).cast(ROW)


def _status(present: Column, name: str) -> Column:
    return F.when(F.coalesce(present, F.lit(False)), name).otherwise("not_provided")


def _given(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) != ""


def agent_areas(agents: DataFrame, findings: DataFrame, declared: DataFrame, assessment: DataFrame,
                summary: DataFrame | None = None) -> DataFrame:
    """(agent_id, area, field, status, evidence): every area that speaks about single agents.

    The inputs are first reduced to one row per agent, joined once, and every area is then an
    entry of one exploded array, so adding an area adds no scan and no shuffle.
    """
    control_rules = list(fv.CONTROL_FIELDS)
    per_agent = findings.where(F.col("rule_id").isin(["SEC001", "SEC002", *control_rules])).groupBy(F.col("agent_id").alias("id")).agg(
        F.min(F.when(F.col("rule_id").isin("SEC001", "SEC002"), F.col("line"))).alias("secret_line"),
        *[F.min(F.when(F.col("rule_id") == r, F.col("line"))).alias(f"gap_{r}") for r in control_rules])
    dims = assessment.where(F.col("dimension").isin(fv.RELIABILITY_DIMENSIONS)).groupBy(F.col("agent_id").alias("id")).agg(
        *[F.max(F.when(F.col("dimension") == dim, L.rank(F.col("exposure"), fv.EXPOSURES))).alias(f"dim_{i}")
          for i, dim in enumerate(fv.RELIABILITY_DIMENSIONS)])
    decl = declared.select(F.col("agent_id").alias("id"), "owner", "purpose", "users", "geography", "production_status",
                           "autonomy_intent", "data_classes", "economic_authority")
    rows = agents.join(decl, "id", "left").join(per_agent, "id", "left").join(dims, "id", "left")
    seen = summary is not None
    if seen:
        rows = rows.join(summary.select(F.col("agent_id").alias("id"), "span_count", F.col("high_impact_actions").alias("actions"), "approval_rate"), "id", "left")
    anchor = {"path": F.col("path"), "line": F.col("line")}
    key = {"key": F.concat(F.lit('agents."'), F.col("id"), F.lit('"'))}
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    money = F.arrays_overlap("permission_tags", L.string_array(fv.MONEY_OR_CONTRACT_TAGS))
    econ = F.col("economic_authority").isNotNull()

    areas = [
        _row("ai_inventory", "model", _status(size("providers"), "scanned"), anchor),
        _row("ai_inventory", "agent", F.lit("scanned"), anchor),
        _row("ai_inventory", "version", F.lit("not_provided")),
        *[_row("ai_inventory", f, _status(size(f) if f == "geography" else _given(f), "declared"), key) for f in fv.INVENTORY_FIELDS],
        _row("data_access", "declared_data_classes", _status(size("data_classes"), "declared"), key),
        _row("data_access", "scanned_authentication_evidence", _status(F.col("secret_line").isNotNull(), "scanned"),
             {"path": F.col("path"), "line": F.col("secret_line")}),
        _row("permissions", "permissions", _status(size("permission_tags") | size("capabilities"), "scanned"),
             {**anchor, "value": F.array_join(F.array_sort(F.array_union("permission_tags", "capabilities")), ",")}),
        _row("dependencies", "foundation_models", _status(size("providers"), "scanned"), {**anchor, "value": F.array_join(F.array_sort("providers"), ",")}),
        _row("dependencies", "external_tools_and_apis", _status(size("integrations"), "scanned"), {**anchor, "value": F.array_join(F.array_sort("integrations"), ",")}),
        *[_row("technical_controls", name, _status(F.col(f"gap_{rule}").isNull(), "scanned"), {"note": F.lit("no gap finding for this control")})
          for rule, name in fv.CONTROL_FIELDS.items()],
        _row("autonomy", "inferred_level", _status(F.col("autonomy_level").isNotNull(), "scanned"), {"value": F.col("autonomy_level")}),
        _row("autonomy", "declared_intent", _status(_given("autonomy_intent"), "declared"), key),
        *[_row("reliability_scores", dim, _status(F.col(f"dim_{i}").isNotNull(), "scanned"), {"value": L.level(F.col(f"dim_{i}"), fv.EXPOSURES)})
          for i, dim in enumerate(fv.RELIABILITY_DIMENSIONS)],
        _row("monitoring", "observability", _status(F.col("gap_CTRL004").isNull(), "scanned"), {"path": F.col("path")}),
        F.when(econ | money, _row("economic_authority", "economic_authority", _status(econ, "declared"), key)),
    ]
    if seen:
        areas += [
            _row("monitoring", "runtime_traces", _status(F.col("span_count").isNotNull(), "observed"), {"span_count": F.col("span_count")}),
            F.when(F.col("actions") > 0, _row("claims_evidence", "approval_gate_log", F.lit("observed"),
                                              {"high_impact_actions": F.col("actions"), "approval_rate": F.col("approval_rate")})),
        ]
    return rows.select(F.col("id").alias("agent_id"), F.explode(F.array_compact(F.array(*areas))).alias("r")).select("agent_id", "r.*")


def _pointers(evidence_refs: DataFrame, category: str, area: str) -> DataFrame:
    """Ingested rows of a category, or one explicit gap when there is none."""
    mine = evidence_refs.where(F.col("category") == category)
    rows = mine.select(F.lit(area).alias("area"), F.lit(category).alias("field"), F.lit("ingested").alias("status"),
                       F.create_map(F.lit("kind"), "kind", F.lit("ref"), "ref", F.lit("date"), "date").alias("evidence"))
    gap = mine.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit(area).alias("area"), F.lit(category).alias("field"), F.lit("not_provided").alias("status"),
        F.lit(None).cast("map<string,string>").alias("evidence"))
    return rows.unionByName(gap)


# FIXED VALUES - areas that list evidence pointers of one category, and organisation facts by area
POINTER_AREAS = {"testing": "security_testing", "safety_testing": "safety_evaluation", "vendor": "vendor_due_diligence",
                 "monitoring": "monitoring", "contracts": "contracts", "historical": "historical_evidence"}
ORGANISATION_FIELDS = {
    "business_exposure": ["industries", "regulated_activities", "max_customer_dependency", "revenue", "customers", "contract_sizes"],
    "societal_impact": ["societal_risk_flags"],
    "accountability": ["release_approval", "incident_response", "risk_acceptance"],
    "safety_evaluation": ["harmful_output_policy"],
}
NEVER_CAPTURED = ["revenue", "customers", "contract_sizes"]


def organisation_areas(facts: DataFrame, evidence_refs: DataFrame) -> DataFrame:
    """Areas that speak about the organisation. ``facts`` is (key, value) of what was declared."""
    wanted = [(a, f) for a, fields in ORGANISATION_FIELDS.items() for f in fields]
    given = facts.where(F.coalesce("value", F.lit("")) != "").groupBy().agg(
        *[F.max(F.when(F.col("key") == f, F.lit(1))).alias(f) for _, f in wanted])
    rows = given.select(F.explode(F.array(*[
        _row(a, f, F.lit("not_provided") if f in NEVER_CAPTURED else _status(F.col(f).isNotNull(), "declared"), {"key": F.lit(f)})
        for a, f in wanted])).alias("r")).select("r.*")
    return union([rows, *[_pointers(evidence_refs, c, a) for c, a in POINTER_AREAS.items()]])


def runtime_records(coverage: DataFrame, runtime_findings: DataFrame) -> DataFrame:
    """Claims evidence: the analysed window and every runtime contradiction."""
    window = coverage.select(
        F.lit("claims_evidence").alias("area"), F.lit("traces_and_runtime_evidence").alias("field"), F.lit("observed").alias("status"),
        F.create_map(F.lit("span_count"), F.col("span_count").cast("string"), F.lit("agents_covered"), F.col("agents_covered").cast("string")).alias("evidence"))
    found = runtime_findings.select(
        F.lit("claims_evidence").alias("area"), F.col("rule_id").alias("field"), F.lit("observed").alias("status"),
        F.create_map(F.lit("agent_id"), "agent_id", F.lit("title"), "title", F.lit("span_id"), "ref_span").alias("evidence"))
    return window.unionByName(found)


def open_contradictions(findings: DataFrame) -> DataFrame:
    """Unsuppressed declared and runtime contradictions."""
    return findings.where(F.col("rule_id").rlike("^(?:DECL|RT)") & ~F.col("suppressed")).drop("suppressed")
