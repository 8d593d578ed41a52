"""Table schemas shared by readers, operators and sinks."""

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRS = T.ArrayType(STR)


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


AMOUNT = struct(amount=DBL, currency=STR)
FLOW_STEP = struct(role=STR, line=INT, snippet=STR)

# one line of a trace file: a header record or a span record
TRACE_RECORD = struct(
    kind=STR, schema=STR, sdk_version=STR, dropped_spans=LONG,
    trace_id=STR, span_id=STR, parent_span_id=STR, agent_id=STR,
    start_ts=STR, end_ts=STR, status=STR, redaction=STR,
    agent_hint=struct(module=STR, qualname=STR),
    capability=STR, integration=STR, provider=STR, model=STR, tool=STR, vocabulary=STR,
    amount=AMOUNT, approval=struct(approved_by=STR, method=STR), approval_span_id=STR,
    from_agent_id=STR, to_agent_id=STR, attrs=T.MapType(STR, STR),
)

FILES = struct(path=STR, language=STR, is_testlike=BOOL, length=LONG, content=STR)

FINDINGS = struct(
    fingerprint=STR, rule_id=STR, title=STR, category=STR, severity=STR, confidence=STR, path=STR,
    line=INT, column=INT, snippet=STR, variant=STR, evidence_tags=STRS, supersedes=STRS,
    gate_eligible=BOOL, flow=T.ArrayType(FLOW_STEP), agent_id=STR,
)

EVIDENCE = T.ArrayType(struct(rule_id=STR, line=INT, description=STR))

AGENTS = struct(
    id=STR, name=STR, symbol=STR, path=STR, language=STR, confidence=STR, detection_score=INT,
    evidence=EVIDENCE, frameworks=STRS, providers=STRS, integrations=STRS, capabilities=STRS,
    permission_tags=STRS, call_sites=T.MapType(STR, INT), controls=STRS,
)

ECONOMIC = struct(max_per_action=AMOUNT, daily_aggregate=AMOUNT, worst_case_customer_loss=AMOUNT)
DECLARED = struct(
    agent_id=STR, name=STR, owner=STR, purpose=STR, users=STR, geography=STRS, production_status=STR,
    autonomy_intent=STR, data_classes=STRS, economic_authority=ECONOMIC,
)
EVIDENCE_REFS = struct(category=STR, kind=STR, ref=STR, date=STR)
APPROVALS = struct(
    ord=LONG, agent_id=STR, agent_name=STR, kind=STR, value=STR, reason=STR, approved_by=STR,
    evidence_fingerprint=STR, expires=STR,
)

# the nested registry document, as far as the jobs read it
REGISTRY_FINDING = struct(
    fingerprint=STR, rule_id=STR, title=STR, category=STR, severity=STR, confidence=STR, path=STR,
    line=INT, column=INT, snippet=STR, suppressed=BOOL, is_new=BOOL, variant=STR, gate_eligible=BOOL,
    dimensions=STRS, message=STR,
)
REGISTRY = struct(
    schema_version=STR,
    repository=struct(name=STR, root=STR, git_ref=STR, base_ref=STR),
    agents=T.ArrayType(struct(
        id=STR, name=STR, symbol=STR, path=STR, language=STR, confidence=STR, detection_score=INT,
        evidence=EVIDENCE, providers=STRS, frameworks=STRS, integrations=STRS, capabilities=STRS,
        permission_tags=STRS, call_sites=T.MapType(STR, INT), findings=T.ArrayType(REGISTRY_FINDING),
        highest_severity=STR,
        dimension_assessment=struct(
            taxonomy=struct(id=STR, version=STR),
            dimensions=T.ArrayType(struct(id=STR, group=STR, assessability=STR, exposure=STR, score=INT))),
        declared=DECLARED,
        autonomy_level=struct(level=STR, signals=T.ArrayType(struct(signal=STR, path=STR, line=INT)), reason=STR),
    )),
    repository_findings=T.ArrayType(REGISTRY_FINDING),
)
