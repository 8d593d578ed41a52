"""SQL for the result checks: every query once more over the same tables, written for DuckDB."""

from auditspark import fixed_values as fv
from auditspark.plans.oracle_views import AGENTS, CODE, DECLARED, FINDINGS, ISO, KNOWN_AGENTS, SPANS, sql_case, sql_in, sql_list, with_views
from auditspark.plans.queries import AS_OF, DOCUMENT_RULES
from auditspark.sources import derived as dv

SQL = {}

HIGH = sql_in(fv.HIGH_IMPACT_CAPABILITIES)
SENSITIVE = sql_in(fv.SENSITIVE_INTEGRATIONS)


def rank(expr: str, order: list[str]) -> str:
    return sql_case(expr, {n: i for i, n in enumerate(order)})


def name_of(expr: str, order: list[str]) -> str:
    return f"({sql_list(order)})[CAST({expr} AS INTEGER) + 1]"


def ordered(levels):
    return {n: i for i, n in enumerate(levels)}


# ------------------------------------------------------------------ spans

KNOWN = "known AS (SELECT * FROM span_flags WHERE agent_id IN (SELECT id FROM agents))"
GIVEN = "given AS (SELECT * FROM span_flags WHERE agent_id IS NOT NULL)"
SUMMARY_OF = """
  SELECT agent_id, count(*) AS span_count, {kinds},
    count(*) FILTER (status = 'error') AS errors,
    CAST(round_even(count(*) FILTER (status = 'error') / count(*), 4) AS DOUBLE) AS error_rate,
    count(*) FILTER (hi) AS high_impact_actions, count(*) FILTER (hi AND approval_span_id IS NOT NULL) AS high_impact_approved,
    CASE WHEN count(*) FILTER (hi) > 0 THEN CAST(round_even(count(*) FILTER (hi AND approval_span_id IS NOT NULL) / count(*) FILTER (hi), 4) AS DOUBLE) END AS approval_rate,
    CASE WHEN count(DISTINCT redaction) > 1 THEN 'mixed' ELSE min(redaction) END AS evidence_quality,
    min(start_at) AS first_at, max(end_at) AS last_at, max(amount) AS max_amount
  FROM {src} GROUP BY agent_id"""


def summary(src: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in fv.SPAN_KINDS)
    return SUMMARY_OF.format(kinds=kinds, src=src)


SQL["span_summary"] = with_views(SPANS, GIVEN, f" s AS ({summary('given')})", body=f"""
SELECT agent_id, span_count, {', '.join('n_' + k for k in fv.SPAN_KINDS)}, errors, error_rate, high_impact_actions, high_impact_approved,
  approval_rate, evidence_quality, strftime(first_at, {ISO}) AS first_ts, strftime(last_at, {ISO}) AS last_ts, max_amount FROM s""")

COUNTS = """
  SELECT agent_id, dim, value, count(*) AS n FROM (
    {parts}) GROUP BY agent_id, dim, value"""


def counts(src, dims):
    return COUNTS.format(parts=" UNION ALL ".join(f"SELECT agent_id, '{x}' AS dim, {x} AS value FROM {src}" for x in dims))


SQL["span_value_counts"] = with_views(SPANS, GIVEN, body=counts("given", ["kind", "status", "capability", "integration", "provider", "model"]))

TOTALS = "SELECT agent_id, currency, CAST(sum(CAST(amount AS DECIMAL(24,4))) AS DOUBLE) AS total FROM {src} WHERE amount IS NOT NULL GROUP BY agent_id, currency"
SQL["span_window_totals"] = with_views(SPANS, GIVEN, body=f"""
SELECT '*' AS agent_id, 'spans' AS currency, CAST(count(*) AS DOUBLE) AS total, strftime(min(start_at), {ISO}) AS start_ts, strftime(max(end_at), {ISO}) AS end_ts FROM spans
UNION ALL SELECT agent_id, currency, total, NULL, NULL FROM ({TOTALS.format(src='given')})""")

FIRST = "row_number() OVER (PARTITION BY {keys} ORDER BY trace_file, trace_line) = 1"
SQL["first_unapproved_ref"] = with_views(SPANS, GIVEN, body=f"""
SELECT agent_id, 'unapproved' AS ref, trace_file AS file, trace_line AS line, span_id FROM given WHERE hi AND approval_span_id IS NULL QUALIFY {FIRST.format(keys='agent_id')}
UNION ALL SELECT agent_id, capability, trace_file, trace_line, span_id FROM given QUALIFY {FIRST.format(keys='agent_id, capability')}""")

MAX_AMOUNT = "SELECT agent_id, amount, currency, trace_file AS file, trace_line AS line, span_id FROM {src} WHERE amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY amount DESC, trace_file, trace_line) = 1"
SQL["max_amount_ref"] = with_views(SPANS, GIVEN, body=MAX_AMOUNT.format(src="given"))

CLASSIFIED = """
classified AS (
  SELECT s.*, CASE WHEN s.agent_id IS NOT NULL AND a.id IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS bucket,
    CASE WHEN a.id IS NOT NULL THEN s.agent_id WHEN s.agent_id IS NOT NULL THEN 'unknown-id:' || s.agent_id
         ELSE hint_module || ':' || hint_qualname END AS key,
    CASE WHEN a.id IS NOT NULL THEN NULL WHEN s.agent_id IS NOT NULL THEN 'agent_id not present in the registry'
         ELSE 'no agent_id supplied (hint only)' END AS reason
  FROM span_flags s LEFT JOIN agents a ON a.id = s.agent_id)"""
SQL["span_correlation"] = with_views(SPANS, KNOWN_AGENTS, CLASSIFIED, body="SELECT bucket, key, reason, count(*) AS span_count FROM classified GROUP BY bucket, key, reason")
SQL["suggested_matches"] = with_views(SPANS, KNOWN_AGENTS, CLASSIFIED, body="""
SELECT DISTINCT k.key, a.id AS agent_id, a.name, a.path
FROM (SELECT DISTINCT key FROM classified WHERE bucket = 'unmatched') k JOIN agents a
  ON a.symbol IN (split_part(split_part(k.key, ':', 1), '.', 1), split_part(split_part(k.key, ':', 1), '.', 2), split_part(split_part(k.key, ':', 2), '.', 1))""")
SQL["unmatched_summaries"] = with_views(SPANS, KNOWN_AGENTS, CLASSIFIED, body=f"""
SELECT key, reason, count(*) AS span_count, count(*) FILTER (kind = 'action') AS n_action, count(*) FILTER (kind = 'tool_call') AS n_tool_call,
  count(*) FILTER (status = 'error') AS errors, CAST(round_even(count(*) FILTER (status = 'error') / count(*), 4) AS DOUBLE) AS error_rate,
  count(*) FILTER (hi) AS high_impact_actions, count(*) FILTER (hi AND approval_span_id IS NOT NULL) AS high_impact_approved, max(amount) AS max_amount,
  CASE WHEN bool_or(redaction = 'redacted') AND bool_or(redaction = 'content') THEN 'mixed' WHEN bool_or(redaction = 'content') THEN 'content' ELSE 'redacted' END AS evidence_quality,
  strftime(min(start_at), {ISO}) AS first_ts, strftime(max(end_at), {ISO}) AS last_ts
FROM classified WHERE bucket = 'unmatched' GROUP BY key, reason""")
SQL["agents_without_spans"] = with_views(SPANS, AGENTS, body="SELECT id AS agent_id FROM agents WHERE id NOT IN (SELECT agent_id FROM spans WHERE agent_id IS NOT NULL)")
SQL["span_delegations"] = with_views(SPANS, GIVEN, body="SELECT DISTINCT agent_id, to_agent_id FROM given WHERE kind = 'delegation'")
SQL["approvals_verified"] = with_views(SPANS, GIVEN, body="""
SELECT a.agent_id, a.trace_id, a.span_id, a.approval_span_id, p.span_id IS NOT NULL AS approval_exists, coalesce(p.end_at <= a.start_at, false) AS approval_precedes
FROM given a LEFT JOIN given p ON p.kind = 'approval' AND p.trace_id = a.trace_id AND p.span_id = a.approval_span_id
WHERE a.hi AND a.approval_span_id IS NOT NULL""")

# ------------------------------------------------------------------ drift

DRIFT = (GIVEN, """
counts AS (
  SELECT agent_id, dim, value, count(*) FILTER (is_now) AS n_now, count(*) FILTER (NOT is_now) AS n_base FROM (
    SELECT agent_id, is_now, 'kind' AS dim, kind AS value FROM given UNION ALL SELECT agent_id, is_now, 'capability', capability FROM given
    UNION ALL SELECT agent_id, is_now, 'integration', integration FROM given) GROUP BY ALL),
totals AS (SELECT agent_id, count(*) FILTER (is_now) AS t_now, count(*) FILTER (NOT is_now) AS t_base FROM given GROUP BY agent_id),
static_caps AS (SELECT id AS agent_id, unnest(capabilities) AS capability FROM agents),
rates AS (
  SELECT agent_id, CAST(round_even(count(*) FILTER (is_now AND approval_span_id IS NOT NULL) / count(*) FILTER (is_now), 4) AS DOUBLE) AS rate_now,
    CAST(round_even(count(*) FILTER (NOT is_now AND approval_span_id IS NOT NULL) / count(*) FILTER (NOT is_now), 4) AS DOUBLE) AS rate_baseline
  FROM given WHERE hi GROUP BY agent_id HAVING count(*) FILTER (is_now) > 0 AND count(*) FILTER (NOT is_now) > 0)""")

NEW_VALUES = f"""
new_values AS (
  SELECT CASE WHEN c.dim = 'capability' AND c.value IN {HIGH} AND s.capability IS NULL THEN 'high' ELSE 'medium' END AS class,
    CASE WHEN c.dim = 'capability' AND c.value IN {HIGH} AND s.capability IS NULL THEN 'new_high_impact_capability'
         WHEN c.dim = 'capability' THEN 'new_capability' ELSE 'new_integration' END AS kind,
    c.agent_id, c.value AS category, CASE WHEN c.dim = 'capability' THEN c.value IN {HIGH} END AS high_impact
  FROM counts c LEFT JOIN static_caps s ON c.dim = 'capability' AND s.agent_id = c.agent_id AND s.capability = c.value
  WHERE c.dim <> 'kind' AND c.n_now > 0 AND c.n_base = 0)"""
SHIFTS = """
shifts AS (
  SELECT agent_id, dim AS field, value AS category, CAST(round_even(rn, 4) AS DOUBLE) AS rate_now, CAST(round_even(rb, 4) AS DOUBLE) AS rate_baseline,
    CAST(round_even(rn / rb, 2) AS DOUBLE) AS ratio, n_now AS count_now
  FROM (SELECT c.*, n_now / t_now AS rn, n_base / t_base AS rb FROM counts c JOIN totals t USING (agent_id) WHERE n_now >= 5 AND n_base > 0)
  WHERE rn / rb >= 2.0 OR rn / rb <= 0.5)"""
DROPS = "drops AS (SELECT agent_id, rate_now, rate_baseline FROM rates WHERE rate_baseline - rate_now >= CAST(0.1 AS DOUBLE))"
BREACHES = f"""
now_spans AS (SELECT * FROM given WHERE is_now),
breaches AS (
  SELECT 'amount_exceeds_declared_max_per_action' AS kind, m.agent_id, m.amount AS observed, d.max_per_action AS declared, m.currency
  FROM ({MAX_AMOUNT.format(src='now_spans')}) m JOIN declared d USING (agent_id) WHERE m.amount > d.max_per_action
  UNION ALL SELECT 'window_total_exceeds_declared_daily_aggregate', t.agent_id, t.total, d.daily, t.currency
  FROM ({TOTALS.format(src='now_spans')}) t JOIN declared d USING (agent_id) WHERE t.currency = d.limit_currency AND t.total > d.daily)"""
GONE = "gone AS (SELECT agent_id, value AS category FROM counts WHERE dim = 'capability' AND n_base > 0 AND n_now = 0)"
SQL["drift_new_values"] = with_views(SPANS, AGENTS, *DRIFT, NEW_VALUES, body="SELECT * FROM new_values")
SQL["drift_frequency_shift"] = with_views(SPANS, AGENTS, *DRIFT, SHIFTS, body="SELECT * FROM shifts")
SQL["drift_approval_drop"] = with_views(SPANS, AGENTS, *DRIFT, DROPS, body="SELECT * FROM drops")
SQL["drift_amount_limits"] = with_views(SPANS, DECLARED, GIVEN, BREACHES, body="SELECT * FROM breaches")
SQL["drift_gone"] = with_views(SPANS, AGENTS, *DRIFT, GONE, body="SELECT * FROM gone")
SQL["drift_summary"] = with_views(SPANS, AGENTS, DECLARED, *DRIFT, NEW_VALUES, SHIFTS, DROPS, BREACHES, GONE, body="""
SELECT count(*) AS events, count(*) FILTER (class = 'high') AS n_high, count(*) FILTER (class = 'medium') AS n_medium, count(*) FILTER (class = 'info') AS n_info,
  CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) FILTER (class = 'high') > 0 THEN 'high' WHEN count(*) FILTER (class = 'medium') > 0 THEN 'medium' ELSE 'info' END AS max_class
FROM (SELECT class FROM new_values UNION ALL SELECT 'medium' FROM shifts UNION ALL SELECT 'high' FROM drops UNION ALL SELECT 'high' FROM breaches UNION ALL SELECT 'info' FROM gone)""")

# ------------------------------------------------------------------ runtime contradictions

RT = (KNOWN, f"""
s AS ({summary('known')}),
maxa AS ({MAX_AMOUNT.format(src='known')}),
tots AS ({TOTALS.format(src='known')}),
unapproved AS (SELECT agent_id, span_id FROM known WHERE hi AND approval_span_id IS NULL QUALIFY {FIRST.format(keys='agent_id')}),
first_cap AS (SELECT agent_id, capability, span_id FROM known QUALIFY {FIRST.format(keys='agent_id, capability')}),
first_high AS (SELECT agent_id, span_id FROM first_cap WHERE capability IN {HIGH} QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY capability) = 1),
base AS (SELECT a.*, d.autonomy_intent, d.production_status, d.max_per_action, d.daily, d.limit_currency FROM agents a LEFT JOIN declared d ON d.agent_id = a.id),
rt0 AS (
  SELECT 'RT001' AS rule_id, b.id, b.path, b.line, 'critical' AS severity, 'high' AS confidence,
    'autonomy_intent=''' || autonomy_intent || ''' vs ' || (high_impact_actions - high_impact_approved) || ' unapproved high-impact action(s)' AS snippet,
    u.span_id AS ref_span, 'autonomy_intent' AS dkey
  FROM base b JOIN s ON s.agent_id = b.id LEFT JOIN unapproved u ON u.agent_id = b.id
  WHERE autonomy_intent IN ('recommend_only', 'human_approved') AND high_impact_actions > high_impact_approved
  UNION ALL SELECT 'RT002', b.id, b.path, b.line, 'high', 'high', 'observed ' || m.amount || ' ' || m.currency || ' > declared max_per_action ' || b.max_per_action,
    m.span_id, 'economic_authority.max_per_action' FROM base b JOIN maxa m ON m.agent_id = b.id WHERE m.currency = b.limit_currency AND m.amount > b.max_per_action
  UNION ALL SELECT 'RT002', b.id, b.path, b.line, 'high', 'high', 'window total ' || t.total || ' ' || b.limit_currency || ' > declared daily_aggregate ' || b.daily,
    m.span_id, 'economic_authority.daily_aggregate' FROM base b JOIN tots t ON t.agent_id = b.id JOIN maxa m ON m.agent_id = b.id
    WHERE t.currency = b.limit_currency AND t.total > b.daily
  UNION ALL SELECT 'RT003', b.id, b.path, b.line, 'high', 'medium', 'observed capability ''' || f.capability || ''' absent from static registry', f.span_id, NULL
    FROM base b JOIN first_cap f ON f.agent_id = b.id WHERE NOT list_contains(b.capabilities, f.capability)
  UNION ALL SELECT 'RT004', b.id, b.path, b.line, 'medium', 'medium', 'production + monitoring declared, zero spans observed', NULL, 'production_status'
    FROM base b WHERE production_status = 'production' AND id NOT IN (SELECT agent_id FROM s)
  UNION ALL SELECT 'RT005', b.id, b.path, b.line, 'info', 'high', 'approval observed on ' || high_impact_actions || '/' || high_impact_actions || ' high-impact action(s)',
    h.span_id, NULL FROM base b JOIN s ON s.agent_id = b.id LEFT JOIN first_high h ON h.agent_id = b.id
    WHERE autonomy_level = 'human_approved' AND high_impact_actions > 0 AND approval_rate = 1.0),
rt AS (
  SELECT rule_id, id AS agent_id, path, line, severity, confidence, snippet, substr(sha256(rule_id || ':' || path || ':' || snippet), 1, 16) AS fingerprint,
    rule_id = 'RT002' OR (rule_id = 'RT003' AND id = 'a10') OR (rule_id = 'RT001' AND id = 'a20') AS suppressed, ref_span,
    CASE WHEN dkey IS NOT NULL THEN 'agents."' || id || '".' || dkey END AS declared_key
  FROM rt0)""")
SQL["rt_contradictions"] = with_views(SPANS, AGENTS, DECLARED, *RT, body="SELECT * FROM rt")
SQL["merge_liveness"] = with_views(SPANS, AGENTS, KNOWN, f" s AS ({summary('known')})", body="""
SELECT a.id, CASE WHEN s.agent_id IS NULL THEN 'idle' ELSE 'active' END AS liveness_state, s.span_count, s.approval_rate, s.evidence_quality
FROM agents a LEFT JOIN s ON s.agent_id = a.id""")
SQL["merge_coverage"] = with_views(SPANS, KNOWN_AGENTS, DECLARED, CLASSIFIED, *RT, body=f"""
SELECT (SELECT count(*) FROM agents) AS agents_total, (SELECT count(*) FROM s) AS agents_covered, count(*) AS span_count,
  count(DISTINCT CASE WHEN bucket = 'unmatched' THEN key END) AS unmatched_agents, (SELECT count(*) FROM rt) AS rt_findings,
  strftime(min(start_at), {ISO}) AS start_ts, strftime(max(end_at), {ISO}) AS end_ts,
  (SELECT max(CASE WHEN evidence_quality = 'content' THEN 1 ELSE 0 END) FROM s) AS quality_content,
  (SELECT max(CASE WHEN evidence_quality = 'mixed' THEN 1 ELSE 0 END) FROM s) AS quality_mixed,
  (SELECT max(CASE WHEN evidence_quality = 'redacted' THEN 1 ELSE 0 END) FROM s) AS quality_redacted
FROM classified""")

# ------------------------------------------------------------------ scoring


def dim_map(name: str, table: dict) -> str:
    rows = ", ".join(f"('{k}', '{x}')" for k, v in table.items() for x in v)
    return f"{name}(key, dimension) AS (VALUES {rows})"


DIMS = "dims(dimension, assessability, grp) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in fv.DIMENSIONS) + ")"
RULE_DIMS = dim_map("rule_dims", {**{r: v for r, v in fv.RULE_DIMENSIONS.items()}, **{f"{r}/{v}": x for (r, v), x in fv.VARIANT_DIMENSIONS.items()}})
CAP_DIMS = dim_map("cap_dims", fv.CAPABILITY_DIMENSIONS)
CTRL_DIMS = dim_map("ctrl_dims", fv.CONTROL_DIMENSIONS)
VARIANT_KEYS = sql_in([f"{r}/{v}" for r, v in fv.VARIANT_DIMENSIONS])


def scoring(prefix: str, findings: str) -> str:
    weight = sql_case("severity", fv.FINDING_WEIGHTS, "0")
    factor = sql_case("confidence", fv.CONFIDENCE_MULTIPLIERS, "1.0")
    return f"""
{prefix}points AS (
  SELECT agent_id, m.dimension, 'f' AS src, CAST({weight} AS DECIMAL(9,2)) * CAST({factor} AS DECIMAL(4,2)) AS p
    FROM {findings} f JOIN rule_dims m ON m.key = CASE WHEN rule_id || '/' || coalesce(variant, '') IN {VARIANT_KEYS} THEN rule_id || '/' || variant ELSE rule_id END WHERE NOT suppressed
  UNION ALL SELECT id, dimension, 'c', {fv.CAPABILITY_WEIGHT} FROM (SELECT id, unnest(capabilities) AS cap FROM agents) JOIN cap_dims ON key = cap
  UNION ALL SELECT id, 'dependency-drift', 'c', {fv.PROVIDER_WEIGHT} FROM agents WHERE len(providers) > 0
  UNION ALL SELECT id, dimension, 'k', -{fv.CONTROL_CREDIT} FROM (SELECT id, unnest(controls) AS ctl FROM agents) JOIN ctrl_dims ON key = ctl),
{prefix}assess0 AS (
  SELECT a.id AS agent_id, d.dimension, d.grp, d.assessability,
    CAST(greatest(0, least(100, round_even(coalesce(sum(p), 0), 0))) AS INTEGER) AS score,
    count(*) FILTER (src = 'f') AS n_find, count(*) FILTER (src = 'c') AS n_cap, count(*) FILTER (src = 'k') AS n_ctrl
  FROM agents a CROSS JOIN dims d LEFT JOIN {prefix}points p ON p.agent_id = a.id AND p.dimension = d.dimension GROUP BY ALL),
{prefix}assess AS (
  SELECT *, CASE WHEN score <= 0 THEN 'none-observed' WHEN score < {fv.BUCKET_LOW} THEN 'low' WHEN score < {fv.BUCKET_MODERATE} THEN 'moderate'
                 WHEN assessability = 'proxy' THEN 'moderate' ELSE 'elevated' END AS exposure FROM {prefix}assess0)"""


SCORE = (AGENTS, FINDINGS, DIMS, RULE_DIMS, CAP_DIMS, CTRL_DIMS, scoring("", "findings"))
EXP_RANK = rank("exposure", fv.EXPOSURES)
ROLL = f"{name_of(f'max({EXP_RANK})', fv.EXPOSURES)} AS max_exposure, count(*) FILTER (exposure = 'elevated') AS agents_elevated, count(*) FILTER (exposure = 'moderate') AS agents_moderate"
SQL["dimension_scores"] = with_views(*SCORE, body="SELECT agent_id, dimension, assessability, score, exposure, n_find, n_cap, n_ctrl FROM assess")
SQL["dimension_rollup"] = with_views(*SCORE, body=f'SELECT dimension, grp AS "group", assessability, {ROLL} FROM assess GROUP BY dimension, grp, assessability')
SQL["dimension_group_rollup"] = with_views(*SCORE, body=f'SELECT grp AS "group", dimension, {ROLL}, CAST(grouping(grp, dimension) AS INTEGER) AS level FROM assess GROUP BY ROLLUP (grp, dimension)')
OVERLAY = (KNOWN, f"""
s AS ({summary('known')}),
mods AS (SELECT agent_id, count(DISTINCT model) AS models, bool_and(regexp_matches(model, '{fv.DATED_SNAPSHOT.replace("'", "''")}')) AS dated FROM known GROUP BY agent_id),
overlaid AS (
  SELECT a.agent_id, a.dimension, a.grp,
    CASE WHEN s.agent_id IS NOT NULL AND a.assessability = 'proxy' THEN 'runtime' ELSE a.assessability END AS assessability,
    CASE WHEN s.agent_id IS NULL OR a.assessability <> 'proxy' THEN a.exposure
         WHEN a.dimension = 'dependency-drift' THEN CASE WHEN m.models > 1 THEN 'elevated' WHEN m.dated THEN 'low' ELSE 'moderate' END
         WHEN s.error_rate >= 0.10 OR coalesce(d.autonomy_intent IN ('recommend_only', 'human_approved') AND s.approval_rate < 1.0, false) THEN 'elevated'
         WHEN s.error_rate >= 0.02 THEN 'moderate' ELSE 'low' END AS exposure,
    CASE WHEN a.assessability = 'proxy' THEN s.span_count END AS window_spans
  FROM assess a LEFT JOIN s ON s.agent_id = a.agent_id LEFT JOIN mods m ON m.agent_id = a.agent_id LEFT JOIN declared d ON d.agent_id = a.agent_id)""")
SQL["runtime_dimensions"] = with_views(SPANS, DECLARED, *SCORE, *OVERLAY, body=f"SELECT agent_id, dimension, assessability, exposure, window_spans FROM overlaid WHERE dimension IN {sql_in(fv.UPGRADEABLE_DIMENSIONS)}")
SQL["runtime_dimension_rollup"] = with_views(SPANS, DECLARED, *SCORE, *OVERLAY, body=f"""
SELECT dimension, grp AS "group", CASE WHEN bool_or(assessability = 'runtime') THEN 'runtime' ELSE min(assessability) END AS assessability, {ROLL} FROM overlaid GROUP BY dimension, grp""")
SQL["unclassified_findings"] = with_views(SPANS, AGENTS, DECLARED, *RT, body="SELECT rule_id, count(*) AS n FROM rt0 GROUP BY rule_id")

SEV_RANK = rank("severity", fv.SEVERITIES)
EXPOSURE = f"""
worst AS (SELECT agent_id, {name_of(f'max({SEV_RANK})', fv.SEVERITIES)} AS highest_severity FROM findings WHERE NOT suppressed GROUP BY agent_id),
exposed0 AS (
  SELECT a.*, w.highest_severity, len(list_filter(capabilities, lambda x: x IN {HIGH})) AS hi, len(list_filter(integrations, lambda x: x IN {SENSITIVE})) AS se
  FROM agents a LEFT JOIN worst w ON w.agent_id = a.id),
exposed AS (
  SELECT *, CAST(3 * hi + 2 * se + len(integrations) + 2 * coalesce({sql_case('highest_severity', fv.EXPOSURE_SEVERITY_RANK)}, 0) + CASE WHEN confidence = 'high' THEN 2 ELSE 0 END AS INTEGER) AS exposure_score,
    hi > 0 OR se >= 2 OR coalesce(highest_severity IN ('critical', 'high'), false) AS is_high_exposure FROM exposed0)"""
SQL["exposure_scores"] = with_views(AGENTS, FINDINGS, EXPOSURE, body="""
SELECT id, highest_severity, exposure_score, CASE WHEN exposure_score >= 14 THEN 'severe' WHEN exposure_score >= 7 THEN 'elevated' WHEN exposure_score >= 3 THEN 'moderate' ELSE 'low' END AS exposure_tier, is_high_exposure FROM exposed""")
SQL["exposure_rank_topk"] = with_views(AGENTS, FINDINGS, EXPOSURE, body="SELECT id, path, exposure_score FROM exposed ORDER BY exposure_score DESC, path, symbol LIMIT 25")
SQL["severity_counts"] = with_views(AGENTS, FINDINGS, body="""
SELECT severity, count(*) FILTER (NOT suppressed) AS total, count(*) FILTER (NOT suppressed AND line % 4 = 0) AS new, count(*) FILTER (suppressed) AS suppressed FROM findings GROUP BY severity""")
GATEABLE = sql_in([r for r, v in fv.RULES.items() if v[3] and not r.startswith("AI")])
SQL["gate"] = with_views(AGENTS, FINDINGS, body=f"""
SELECT fingerprint, path, line, rule_id, severity, confidence FROM findings
WHERE NOT suppressed AND (gate_eligible OR ((rule_id = 'AI001' OR rule_id IN {GATEABLE}) AND confidence = 'high'))
  AND ({SEV_RANK} >= 3 OR (line % 4 = 0 AND {SEV_RANK} >= 2))
QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY path DESC, line DESC, rule_id DESC) = 1""")
SQL["summary_table"] = with_views(AGENTS, FINDINGS, EXPOSURE, body="""
SELECT (SELECT count(*) FROM exposed) AS agents, (SELECT count(*) FILTER (confidence = 'high') FROM exposed) AS high_confidence,
  (SELECT count(*) FILTER (is_high_exposure) FROM exposed) AS high_exposure,
  count(*) FILTER (NOT suppressed AND severity = 'critical' AND line % 4 = 0) AS new_critical,
  count(*) FILTER (NOT suppressed AND severity = 'critical' AND line % 4 <> 0) AS existing_critical, count(*) FILTER (suppressed) AS suppressed FROM findings""")

# ------------------------------------------------------------------ graph

EDGE_RULES = {"provider": fv.PROVIDER_EDGE_RULES, "tool": fv.TOOL_EDGE_RULES, "network": fv.NETWORK_EDGE_RULES,
              "database": fv.DATABASE_EDGE_RULES, "exec": fv.EXEC_EDGE_RULES, "high-impact": fv.HIGH_IMPACT_EDGE_RULES}
GRAPH = f"""
edge_rules(category, rule_id) AS (VALUES {', '.join(f"('{c}', '{r}')" for c, rs in EDGE_RULES.items() for r in rs)}),
cap_links AS (SELECT id AS source, 'resource_' || cap AS target, {sql_case('cap', fv.EDGE_KIND)} AS kind, cap FROM (SELECT id, unnest(capabilities) AS cap FROM agents)),
links AS (
  SELECT id AS source, 'tool_' || unnest(integrations) AS target, 'tool_call' AS kind, 'tool' AS category, NULL AS cap FROM agents
  UNION ALL SELECT id, 'tool_' || unnest(providers), 'tool_call', 'provider', NULL FROM agents
  UNION ALL SELECT source, target, kind, 'none', cap FROM cap_links WHERE kind IS NOT NULL
  UNION ALL SELECT source, target, kind, 'database', cap FROM cap_links WHERE cap IN ('database_read', 'database_write')
  UNION ALL SELECT source, target, kind, 'exec', cap FROM cap_links WHERE cap IN ('code_execution', 'shell_execution')
  UNION ALL SELECT source, target, kind, 'network', cap FROM cap_links WHERE kind = 'network'
  UNION ALL SELECT source, target, kind, 'high-impact', cap FROM cap_links WHERE cap IN {HIGH}),
explained AS (
  SELECT l.source, l.target, l.kind, l.cap, f.rule_id, f.path, f.line, f.severity
  FROM links l LEFT JOIN (SELECT e.category, f.* FROM edge_rules e JOIN findings f USING (rule_id)) f ON f.category = l.category AND f.agent_id = l.source),
edges AS (
  SELECT source, target, kind, {name_of(f'max({SEV_RANK})', fv.SEVERITIES)} AS max_severity, CAST(1 AS INTEGER) AS weight, 'declared' AS provenance FROM explained GROUP BY source, target, kind),
labels AS (SELECT DISTINCT target AS id, CASE WHEN cap IS NULL THEN substr(target, 6)
    ELSE coalesce({sql_case('cap', fv.CAPABILITY_LABELS)}, upper(cap[1]) || replace(substr(cap, 2), '_', ' ')) END AS label, cap IS NULL AS tool FROM links),
nodes AS (
  SELECT a.id, CASE WHEN framework = 'mcp' THEN 'mcp_server' ELSE 'agent' END AS type, name AS label, path, symbol, w.highest_severity AS worst_severity
  FROM agents a LEFT JOIN worst w ON w.agent_id = a.id
  UNION ALL SELECT id, CASE WHEN tool THEN 'tool' ELSE 'resource' END, label, NULL, NULL, NULL FROM labels)"""
GRAPHED = (AGENTS, FINDINGS, EXPOSURE, GRAPH)
SQL["graph_nodes"] = with_views(*GRAPHED, body="SELECT * FROM nodes")
SQL["graph_edges"] = with_views(*GRAPHED, body="SELECT * FROM edges")
SQL["graph_edge_findings"] = with_views(*GRAPHED, body="SELECT DISTINCT source, target, kind, rule_id, path, line, severity FROM explained WHERE rule_id IS NOT NULL")
SQL["graph_node_severity"] = with_views(*GRAPHED, body=f"""
SELECT id, {name_of('max(r)', fv.SEVERITIES)} AS display_severity FROM (
  SELECT id, {rank('worst_severity', fv.SEVERITIES)} AS r FROM nodes UNION ALL SELECT source, {rank('max_severity', fv.SEVERITIES)} FROM edges
  UNION ALL SELECT target, {rank('max_severity', fv.SEVERITIES)} FROM edges) GROUP BY id""")
SQL["graph_overlay"] = with_views(SPANS, *GRAPHED, KNOWN, f"""
seen AS (
  SELECT DISTINCT agent_id AS source, 'resource_' || capability AS target, {sql_case('capability', fv.EDGE_KIND)} AS kind FROM known WHERE capability IN {sql_in(list(fv.EDGE_KIND))}
  UNION SELECT DISTINCT agent_id, 'tool_' || integration, 'tool_call' FROM known),
handed AS (SELECT DISTINCT agent_id AS source, to_agent_id AS target, 'delegates' AS kind FROM known WHERE kind = 'delegation' AND to_agent_id IN (SELECT id FROM nodes))""", body="""
SELECT coalesce(e.source, o.source) AS source, coalesce(e.target, o.target) AS target, coalesce(e.kind, o.kind) AS kind, e.max_severity, coalesce(e.weight, 1) AS weight,
  CASE WHEN e.source IS NULL THEN 'observed' ELSE 'declared' END AS provenance, e.source IS NOT NULL AND o.source IS NOT NULL AS observed
FROM edges e FULL JOIN (SELECT * FROM seen UNION ALL SELECT * FROM handed) o ON e.source = o.source AND e.target = o.target AND e.kind = o.kind""")
SQL["graph_focus"] = with_views(*GRAPHED, """
near AS (SELECT source AS id FROM edges WHERE target = 'a0' UNION SELECT target FROM edges WHERE source = 'a0' UNION SELECT 'a0')""", body="""
SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)""")
SQL["delegation_reach"] = "WITH RECURSIVE " + SPANS + "," + GIVEN + """,
hops AS (SELECT DISTINCT agent_id AS source, to_agent_id AS target FROM given WHERE kind = 'delegation'),
reach(id, hops) AS (
  SELECT DISTINCT source, 0 FROM hops WHERE source NOT IN (SELECT target FROM hops WHERE target IS NOT NULL)
  UNION SELECT h.target, r.hops + 1 FROM reach r JOIN hops h ON h.source = r.id WHERE r.hops < (SELECT count(*) FROM hops))
SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM reach GROUP BY id"""

# ------------------------------------------------------------------ declared facts

SQL["declared_validated"] = with_views(DECLARED, body="""
SELECT agent_id, users, production_status, autonomy_intent, array_to_string(data_classes, ',') AS data_classes, max_per_action FROM declared""")
SQL["declared_warnings"] = with_views(DECLARED, body=f"""
SELECT agent_id, 'users' AS field, users AS value FROM declared_raw WHERE users NOT IN {sql_in(fv.USERS_VALUES)}
UNION ALL SELECT agent_id, 'production_status', production_status FROM declared_raw WHERE production_status NOT IN {sql_in(fv.PRODUCTION_STATUSES)}
UNION ALL SELECT agent_id, 'autonomy_intent', autonomy_intent FROM declared_raw WHERE autonomy_intent NOT IN {sql_in(fv.AUTONOMY_INTENTS)}
UNION ALL SELECT agent_id, 'data_classes', 'secrets' FROM declared_raw WHERE list_contains(data_classes, 'secrets')""")
DECL = f"""
secrets AS (SELECT agent_id, path, line FROM findings WHERE rule_id IN ('SEC001', 'SEC002') QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY line, rule_id, fingerprint) = 1),
quiet AS (SELECT agent_id, path, min(line) AS line FROM findings WHERE rule_id = 'CTRL004' GROUP BY agent_id, path),
joined AS (SELECT a.*, d.agent_id IS NOT NULL AS is_declared, d.autonomy_intent, d.production_status, d.data_classes, d.max_per_action IS NOT NULL AS econ,
    s.path AS spath, s.line AS sline, q.path AS qpath, q.line AS qline
  FROM agents a LEFT JOIN declared d ON d.agent_id = a.id LEFT JOIN secrets s ON s.agent_id = a.id LEFT JOIN quiet q ON q.agent_id = a.id),
decl0 AS (
  SELECT 'DECL001' AS rule_id, id, path, line, 'critical' AS severity, 'autonomy_intent=''' || autonomy_intent || ''' vs inferred=''' || autonomy_level || '''' AS snippet, '.autonomy_intent' AS k
    FROM joined WHERE is_declared AND autonomy_intent IN ('recommend_only', 'human_approved') AND autonomy_level IN ('bounded_autonomous', 'unrestricted_autonomous')
  UNION ALL SELECT 'DECL002', id, path, line, 'high', 'economic_authority declared for `' || symbol || '`, no bounding signal', '.economic_authority'
    FROM joined WHERE is_declared AND econ AND list_has_any(permission_tags, {sql_list(fv.MONEY_TAGS)}) AND NOT has_bounding
  UNION ALL SELECT 'DECL003', id, path, line, 'high', 'money/contract permission for `' || symbol || '`, no economic_authority declared', '.economic_authority'
    FROM joined WHERE list_has_any(permission_tags, {sql_list(fv.MONEY_OR_CONTRACT_TAGS)}) AND NOT econ
  UNION ALL SELECT 'DECL004', id, spath, sline, 'high', 'credential evidence for `' || symbol || '`, ''authentication'' not declared', '.data_classes'
    FROM joined WHERE is_declared AND spath IS NOT NULL AND NOT list_contains(data_classes, 'authentication')
  UNION ALL SELECT 'DECL005', id, qpath, qline, 'medium', 'production_status=production for `' || symbol || '`, CTRL004 fired', '.production_status'
    FROM joined WHERE is_declared AND production_status = 'production' AND qpath IS NOT NULL
  UNION ALL SELECT 'DECL006', id, path, line, 'medium', 'no declaration entry for `' || symbol || '`', '' FROM joined WHERE NOT is_declared
  UNION ALL SELECT 'DECL007', agent_id, 'declared.toml', 1, 'low', 'agents."' || agent_id || '"', '' FROM declared WHERE agent_id NOT IN (SELECT id FROM agents)),
decl AS (
  SELECT rule_id, id AS agent_id, path, line, severity, snippet, substr(sha256(rule_id || ':' || path || ':' || rule_id || ':' || id), 1, 16) AS fingerprint,
    'agents."' || id || '"' || k AS declared_key FROM decl0)"""
SQL["decl_contradictions"] = with_views(KNOWN_AGENTS, FINDINGS, DECLARED, DECL, body="SELECT * FROM decl")
SQL["assurance_contradictions"] = with_views(SPANS, KNOWN_AGENTS, FINDINGS, DECLARED, DECL, *RT, body="""
SELECT rule_id, path, line, severity FROM decl UNION ALL SELECT rule_id, path, line, severity FROM rt WHERE NOT suppressed""")


def st(cond: str, name: str) -> str:
    return f"CASE WHEN coalesce({cond}, false) THEN '{name}' ELSE 'not_provided' END"


_AREAS = [
    ("ai_inventory", "model", st("len(a.providers) > 0", "scanned")), ("ai_inventory", "agent", "'scanned'"), ("ai_inventory", "version", "'not_provided'"),
    *[("ai_inventory", f, st(f"d.{f} IS NOT NULL", "declared")) for f in fv.INVENTORY_FIELDS],
    ("data_access", "declared_data_classes", st("len(d.data_classes) > 0", "declared")),
    ("data_access", "scanned_authentication_evidence", st("list_has_any(f.rules, ['SEC001', 'SEC002'])", "scanned")),
    ("permissions", "permissions", st("len(a.permission_tags) > 0 OR len(a.capabilities) > 0", "scanned")),
    ("dependencies", "foundation_models", st("len(a.providers) > 0", "scanned")),
    ("dependencies", "external_tools_and_apis", st("len(a.integrations) > 0", "scanned")),
    *[("technical_controls", n, st(f"NOT coalesce(list_contains(f.rules, '{r}'), false)", "scanned")) for r, n in fv.CONTROL_FIELDS.items()],
    ("autonomy", "inferred_level", "'scanned'"), ("autonomy", "declared_intent", st("d.autonomy_intent IS NOT NULL", "declared")),
    *[("reliability_scores", x, "'scanned'") for x in fv.RELIABILITY_DIMENSIONS],
    ("monitoring", "observability", st("NOT coalesce(list_contains(f.rules, 'CTRL004'), false)", "scanned")),
    ("monitoring", "runtime_traces", st("s.agent_id IS NOT NULL", "observed")),
    ("economic_authority", "economic_authority", st("d.max_per_action IS NOT NULL", "declared")),
    ("claims_evidence", "approval_gate_log", "'observed'"),
]
SQL["assurance_long"] = with_views(SPANS, AGENTS, FINDINGS, DECLARED, KNOWN, f"""
s AS ({summary('known')}), rules AS (SELECT agent_id, list(DISTINCT rule_id) AS rules FROM findings GROUP BY agent_id),
packet AS (SELECT a.id, a.permission_tags, d.max_per_action, s.high_impact_actions, unnest([{', '.join(f"struct_pack(area := '{x}', field := '{f}', status := {e})" for x, f, e in _AREAS)}]) AS r
  FROM agents a LEFT JOIN declared d ON d.agent_id = a.id LEFT JOIN rules f ON f.agent_id = a.id LEFT JOIN s ON s.agent_id = a.id)""", body=f"""
SELECT r.area AS area, id AS agent_id, r.field AS field, r.status AS status FROM packet
WHERE (r.area <> 'economic_authority' OR max_per_action IS NOT NULL OR list_has_any(permission_tags, {sql_list(fv.MONEY_OR_CONTRACT_TAGS)}))
  AND (r.area <> 'claims_evidence' OR coalesce(high_impact_actions > 0, false))""")

# ------------------------------------------------------------------ snapshot diff

SNAP = f"""
order_rows AS (
  SELECT 'a' || (o_custkey * 5 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1) AS agent_id, ({sql_list(dv.CAPABILITIES)})[CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 23 + 1] AS capability,
    ({sql_list(dv.INTEGRATIONS)})[length(p_type) * 3 + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 4 + 1] AS integration, l_shipdate < TIMESTAMP '1998-05-24' AS is_base
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
items AS (SELECT DISTINCT agent_id, is_base, 'capability' AS kind, capability AS value FROM order_rows UNION SELECT DISTINCT agent_id, is_base, 'integration', integration FROM order_rows),
match AS (SELECT agent_id AS id, CASE WHEN bool_or(is_base) AND bool_or(NOT is_base) THEN 'common' WHEN bool_or(is_base) THEN 'removed' ELSE 'added' END AS status FROM items GROUP BY agent_id),
added AS (SELECT i.agent_id, CASE WHEN bool_or((kind = 'capability' AND value IN {HIGH}) OR (kind = 'integration' AND value IN {SENSITIVE})) THEN 'high' ELSE 'medium' END AS drift,
    CASE WHEN bool_or(kind = 'capability' AND value IN {HIGH}) THEN 'new agent binds high-impact capability ' || min(value) FILTER (kind = 'capability' AND value IN {HIGH})
         WHEN bool_or(kind = 'integration' AND value IN {SENSITIVE}) THEN 'new agent binds a sensitive integration' ELSE 'new agent' END AS reason
  FROM items i JOIN match m ON m.id = i.agent_id AND m.status = 'added' GROUP BY i.agent_id),
changes AS (
  SELECT agent_id, kind, value, CASE WHEN bool_or(is_base) THEN 'removed' ELSE 'added' END AS change,
    CASE kind WHEN 'capability' THEN value IN {HIGH} ELSE value IN {SENSITIVE} END AS flagged,
    CASE WHEN bool_or(is_base) THEN 'info' WHEN CASE kind WHEN 'capability' THEN value IN {HIGH} ELSE value IN {SENSITIVE} END THEN 'high' ELSE 'medium' END AS drift
  FROM items WHERE agent_id IN (SELECT id FROM match WHERE status = 'common') GROUP BY agent_id, kind, value HAVING count(*) = 1),
apps AS (
  SELECT c_custkey * 100 + i * 2 + r AS ord, 'a' || c_custkey AS agent_id, 'capability' AS kind, ({sql_list(dv.CAPABILITIES)})[i + 1] AS value,
    CASE WHEN (c_custkey + i + r) % 5 = 0 THEN 'feedfacefeed' END AS fp,
    CASE (c_custkey + i + r) % 4 WHEN 0 THEN DATE '1996-01-01' WHEN 1 THEN DATE '2099-12-31' END AS expires
  FROM customer, (SELECT unnest(range({len(dv.CAPABILITIES)})) AS i) WHERE i % 3 = 0),
apps2 AS (SELECT 1 AS x)"""
SNAP = SNAP.replace("FROM customer, (SELECT unnest(range(", "FROM customer, (SELECT unnest([0, 1]) AS r), (SELECT unnest(range(").replace(",\napps2 AS (SELECT 1 AS x)", "")
APPROVED = f"""
first_app AS (SELECT * FROM apps QUALIFY row_number() OVER (PARTITION BY agent_id, kind, value ORDER BY ord) = 1),
approved AS (
  SELECT c.agent_id, c.kind, c.value, c.drift,
    f.ord IS NOT NULL AND NOT coalesce(f.expires < DATE '{AS_OF}', false) AND NOT coalesce(f.fp <> substr(sha256(c.agent_id), 1, 12), false) AS approved,
    CASE WHEN coalesce(f.expires < DATE '{AS_OF}', false) THEN 'expired' WHEN coalesce(f.fp <> substr(sha256(c.agent_id), 1, 12), false) THEN 'evidence changed' END AS stale_reason
  FROM changes c LEFT JOIN first_app f ON f.agent_id = c.agent_id AND f.kind = c.kind AND f.value = c.value WHERE c.change = 'added')"""
FSNAP = """
fsides AS (SELECT *, (line * 7 + length(rule_id) * 3) % 5 <> 0 AS in_base, (line * 7 + length(rule_id) * 3) % 5 <> 1 AS in_head FROM findings),
fchanges AS (SELECT agent_id, fingerprint, rule_id, severity, line, CASE WHEN in_head THEN 'new' ELSE 'resolved' END AS change FROM fsides WHERE in_base <> in_head)"""
SQL["snapshot_diff_agents"] = with_views(SNAP, body="""
SELECT agent_id, 'added' AS status, drift, reason FROM added UNION ALL SELECT id, 'removed', 'info', NULL FROM match WHERE status = 'removed'""")
SQL["snapshot_diff_items"] = with_views(SNAP, body="SELECT * FROM changes")
SQL["snapshot_diff_approved"] = with_views(SNAP, APPROVED, body="SELECT * FROM approved")
SQL["snapshot_diff_findings"] = with_views(AGENTS, FINDINGS, FSNAP, body="SELECT * FROM fchanges")
SQL["snapshot_diff_summary"] = with_views(SNAP, APPROVED, AGENTS, FINDINGS, FSNAP, f"""
fc AS (SELECT * FROM fchanges WHERE agent_id IN (SELECT id FROM match WHERE status = 'common')),
entries AS (SELECT 1 AS esc, drift, approved FROM approved UNION ALL SELECT 0, drift, false FROM added)""", body=f"""
SELECT count(*) FILTER (esc = 1 AND drift = 'high') AS escalations_high, count(*) FILTER (esc = 1 AND drift = 'medium') AS escalations_medium, count(*) FILTER (esc = 1 AND drift = 'low') AS escalations_low,
  count(*) FILTER (approved) AS approvals_applied, {name_of(f"coalesce(max({rank('drift', fv.DIFF_LEVELS)}), 0)", fv.DIFF_LEVELS)} AS max_drift,
  {name_of(f"coalesce(max({rank('drift', fv.DIFF_LEVELS)}) FILTER (NOT approved), 0)", fv.DIFF_LEVELS)} AS unapproved_max_drift,
  (SELECT count(*) FILTER (status = 'added') FROM match) AS agents_added, (SELECT count(*) FILTER (status = 'removed') FROM match) AS agents_removed,
  (SELECT count(DISTINCT agent_id) FROM (SELECT agent_id FROM changes UNION SELECT agent_id FROM fc)) AS agents_changed,
  (SELECT count(DISTINCT agent_id) FROM changes WHERE change = 'removed') AS reductions,
  (SELECT count(*) FILTER (change = 'new' AND severity = 'critical') FROM fc) AS new_critical, (SELECT count(*) FILTER (change = 'new' AND severity = 'high') FROM fc) AS new_high,
  (SELECT count(*) FILTER (change = 'resolved') FROM fc) AS resolved FROM entries""")
SQL["snapshot_diff_dimensions"] = with_views(AGENTS, FINDINGS, DIMS, RULE_DIMS, CAP_DIMS, CTRL_DIMS, FSNAP,
    " fb AS (SELECT * FROM fsides WHERE in_base), fh AS (SELECT * FROM fsides WHERE in_head)", scoring("b", "fb"), scoring("h", "fh"), body=f"""
SELECT b.agent_id, b.dimension, b.exposure AS "from", h.exposure AS "to",
  CASE WHEN {rank('h.exposure', fv.EXPOSURES)} > {rank('b.exposure', fv.EXPOSURES)} THEN 'increased' ELSE 'decreased' END AS direction
FROM bassess b JOIN hassess h USING (agent_id, dimension) WHERE b.exposure <> h.exposure""")
SQL["changelog"] = with_views(SNAP, AGENTS, FINDINGS, FSNAP, body="""
SELECT 'escalation' AS section, agent_id, '+ ' || value AS change, drift FROM changes WHERE change = 'added'
UNION ALL SELECT 'new agent', agent_id, reason, drift FROM added
UNION ALL SELECT 'reduction', agent_id, '- ' || value, drift FROM changes WHERE change = 'removed'
UNION ALL SELECT 'reduction', id, 'agent no longer detected', 'info' FROM match WHERE status = 'removed'
UNION ALL SELECT 'finding', agent_id, 'new ' || severity || ' ' || rule_id, severity FROM fchanges WHERE change = 'new' AND agent_id IN (SELECT id FROM match WHERE status = 'common')""")
RENAMED = """
sides AS (
  SELECT DISTINCT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24' THEN 'b' ELSE 'h' END AS side, l_suppkey, p_brand || '/' || p_size % 8 AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ev AS (SELECT side || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS id, side, kind FROM sides),
sizes AS (SELECT id, count(*) AS n FROM ev GROUP BY id),
common AS (SELECT b.id AS base_id, h.id AS head_id, count(*) AS c FROM ev b JOIN ev h ON b.side = 'b' AND h.side = 'h' AND b.kind = h.kind GROUP BY ALL),
scored AS (SELECT base_id, head_id, c / (x.n + y.n - c) AS jaccard FROM common JOIN sizes x ON x.id = base_id JOIN sizes y ON y.id = head_id WHERE c / (x.n + y.n - c) >= 0.7)"""
# base ids choose one after the other
SQL["rename_assignment"] = "WITH RECURSIVE " + RENAMED + """,
bases AS (SELECT base_id, row_number() OVER (ORDER BY base_id) AS i FROM (SELECT DISTINCT base_id FROM scored)),
walk(i, taken, base_id, pick) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS STRUCT(head_id VARCHAR, jaccard DOUBLE))
  UNION ALL
  SELECT b.i, CASE WHEN o.pick IS NULL THEN w.taken ELSE list_append(w.taken, o.pick.head_id) END, b.base_id, o.pick
  FROM walk w JOIN bases b ON b.i = w.i + 1, LATERAL (
    SELECT arg_min(struct_pack(head_id := s.head_id, jaccard := CAST(s.jaccard AS DOUBLE)), (-s.jaccard, s.head_id)) AS pick
    FROM scored s WHERE s.base_id = b.base_id AND NOT list_contains(w.taken, s.head_id)) o)
SELECT base_id, pick.head_id AS head_id, pick.jaccard AS jaccard FROM walk WHERE pick IS NOT NULL"""
SQL["rename_best_candidate"] = "WITH " + RENAMED + """
SELECT base_id, head_id, jaccard FROM scored QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY jaccard DESC, head_id) = 1"""

# ------------------------------------------------------------------ documents

DOC_LINES = """
doc_lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, unnest(regexp_split_to_array(text, '\\r?\\n')) AS text,
    unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS line FROM documents)"""
# the position of the first match: one past the text before it
_POS = "length(regexp_extract(text, '^(?s:(.*?))(?:' || p || ')', 1)) + 1"
SQL["doc_rule_scan"] = with_views(DOC_LINES, body=" UNION ALL ".join(
    f"SELECT path, CAST(line AS INTEGER) AS line, '{name}' AS rule, CAST(length(regexp_extract(text, '{'(?i)' if p.startswith('(?i)') else ''}^((?s:.*?))(?:{p.replace('(?i)', '')})', 1)) + 1 AS INTEGER) AS \"column\" FROM doc_lines WHERE regexp_matches(text, '{p}')"
    for name, p in DOCUMENT_RULES.items()))
TOKEN = DOCUMENT_RULES["token"]
TOKENS = f"""
tokens AS (
  SELECT path, line, text, unnest(regexp_extract_all(text, '{TOKEN}')) AS token, unnest(range(len(regexp_extract_all(text, '{TOKEN}')))) AS nth FROM doc_lines WHERE regexp_matches(text, '{TOKEN}')),
chars AS (SELECT path, line, nth, text, token, ch, count(*) / length(token) AS p FROM (SELECT *, unnest(string_split(token, '')) AS ch FROM tokens) GROUP BY path, line, nth, text, token, ch),
ent AS (SELECT path, line, nth, text, token, -sum(p * log2(p)) AS e FROM chars GROUP BY path, line, nth, text, token)"""
SQL["doc_secret_entropy"] = with_views(DOC_LINES, TOKENS, body=f"""
SELECT path, CAST(line AS INTEGER) AS line, CAST(nth AS INTEGER) AS nth, CAST(round_even(e, 6) AS DOUBLE) AS entropy,
  CASE WHEN regexp_matches(token, '{fv.PLACEHOLDER}') OR regexp_matches(text, '{fv.PLACEHOLDER}') OR e < 3.0 OR regexp_matches(text, '{fv.COMMENT_LINE}') THEN 'low' ELSE 'high' END AS confidence FROM ent""")
SQL["doc_redacted"] = "WITH RECURSIVE " + DOC_LINES + "," + TOKENS + f""",
red(path, line, nth, i, shown) AS (
  SELECT path, line, nth, 0, text FROM tokens
  UNION ALL SELECT r.path, r.line, r.nth, r.i + 1, replace(r.shown, t.token, substr(t.token, 1, 6) || '…[REDACTED:' || substr(sha256(t.token), 1, 12) || ']')
  FROM red r JOIN tokens t ON t.path = r.path AND t.line = r.line AND t.nth = r.i)
SELECT path, CAST(line AS INTEGER) AS line, CAST(nth AS INTEGER) AS nth, shown FROM red QUALIFY row_number() OVER (PARTITION BY path, line, nth ORDER BY i DESC) = 1"""
SQL["doc_fingerprints"] = with_views(DOC_LINES, f"""
shown AS (SELECT path, line, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS snippet FROM doc_lines WHERE regexp_matches(text, '{DOCUMENT_RULES['license']}')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path, snippet ORDER BY line) - 1 AS nth FROM shown)""", body="""
SELECT path, CAST(line AS INTEGER) AS line, nth, substr(sha256('LIC001:' || path || ':' || snippet || CASE WHEN nth > 0 THEN '#' || nth ELSE '' END), 1, 16) AS fingerprint FROM numbered""")
_LOCAL = fv.LOCAL_HOST.replace("'", "''")
_HTTP = fv.HTTP_URL.replace("'", "''")
SQL["insecure_urls"] = f"""
SELECT page_id, list_filter(regexp_extract_all(url, '{_HTTP}', 1), lambda h: NOT regexp_matches(h, '{_LOCAL}'))[1] AS host FROM pages
WHERE len(list_filter(regexp_extract_all(url, '{_HTTP}', 1), lambda h: NOT regexp_matches(h, '{_LOCAL}'))) > 0"""
