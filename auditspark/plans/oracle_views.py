"""The derived views once more, as SQL text over the same tables, for result checks."""

from auditspark.sources import derived as d
from auditspark import fixed_values as fv


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_case(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"

SPANS = f"""
raw_events AS (
  SELECT event_id, user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
spans AS (
  SELECT 'trace-' || lpad(CAST(event_id // 1000 AS VARCHAR), 6, '0') || '.jsonl' AS trace_file,
    event_id % 1000 + 2 AS trace_line, 't' || user_id || '-' || day(ts) AS trace_id, 's' || event_id AS span_id,
    CASE WHEN k % 19 = 3 THEN 'approval' WHEN k % 23 = 4 THEN 'delegation'
         WHEN event_type IN ('purchase', 'signup') THEN 'action' WHEN event_type = 'click' THEN 'tool_call'
         WHEN event_type = 'view' THEN 'retrieval' ELSE 'llm_call' END AS kind,
    CASE WHEN k % 17 <> 5 THEN 'a' || user_id END AS agent_id,
    'svc.c' || user_id AS hint_module, 'Run.step' AS hint_qualname,
    date_trunc('millisecond', ts) AS start_at,
    date_trunc('millisecond', ts + to_milliseconds(k)) AS end_at,
    CASE WHEN event_type = 'error' AND k % 4 = user_id % 4 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN k = 50 THEN 'content' ELSE 'redacted' END AS redaction,
    ({sql_list(d.CAPABILITIES)})[k % 23 + 1] AS capability,
    ({sql_list(d.INTEGRATIONS)})[k % 11 + 1] AS integration,
    ({sql_list(d.PROVIDERS)})[k % 5 + 1] AS provider,
    CASE WHEN user_id % 3 = 0 THEN '{d.MODELS[0]}' WHEN user_id % 3 = 1 THEN '{d.MODELS[1]}'
         ELSE ({sql_list(d.MODELS)})[k % 3 + 1] END AS model,
    CASE WHEN event_type = 'purchase' THEN value END AS amount,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 7 THEN 'EUR' ELSE 'USD' END END AS currency,
    CASE WHEN CASE WHEN user_id % 20 = 7 THEN true WHEN ts >= TIMESTAMP '{d.CUTOFF[:10]}' THEN k % 6 = 0 ELSE k % 3 = 0 END
         THEN 's' || (event_id - 1) END AS approval_span_id,
    CASE WHEN k % 19 <> 3 AND k % 23 = 4 THEN 'a' || ((user_id * 7 + k) % 1500) END AS to_agent_id,
    event_type, k
  FROM raw_events),
span_flags AS (
  SELECT *, capability IN {sql_in(fv.HIGH_IMPACT_CAPABILITIES)} AND kind IN ('action', 'tool_call') AS hi,
    start_at >= TIMESTAMP '{d.CUTOFF[:10]}' AS is_now FROM spans)"""


def chosen(values, key, a, b, mod, below) -> str:
    parts = ", ".join(
        f"CASE WHEN ({key} * {a} + {i * b}) % {mod} < {below} THEN '{v}' END" for i, v in enumerate(values))
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


AGENTS = f"""
agents AS (
  SELECT c_custkey AS key, 'a' || c_custkey AS id, 'agent_' || c_custkey AS name, 'c' || c_custkey AS symbol,
    'svc/m' || (c_custkey % 40) || '/c' || c_custkey || '.py' AS path, CAST(c_custkey % 50 + 1 AS INTEGER) AS line,
    ({sql_list(fv.CONFIDENCES)})[c_custkey % 3 + 1] AS confidence,
    CASE WHEN c_custkey % 12 = 0 THEN 'mcp' ELSE 'langchain' END AS framework,
    {chosen(d.CAPABILITIES, 'c_custkey', 31, 17, 5, 2)} AS capabilities,
    {chosen(d.INTEGRATIONS, 'c_custkey', 13, 7, 9, 1)} AS integrations,
    {chosen(d.PROVIDERS, 'c_custkey', 11, 5, 8, 1)} AS providers,
    {chosen(list(fv.PERMISSION_PATTERNS), 'c_custkey', 3, 2, 7, 2)} AS permission_tags,
    {chosen(list(fv.CONTROL_DIMENSIONS), 'c_custkey', 5, 3, 6, 2)} AS controls,
    (['recommend_only', 'human_approved', 'bounded_autonomous', 'unrestricted_autonomous', 'indeterminate'])[c_custkey % 5 + 1] AS autonomy_level,
    c_custkey % 15 = 3 AS has_bounding
  FROM customer)"""
# where unknown ids are the point, every tenth agent is missing from the registry
KNOWN_AGENTS = AGENTS.replace("FROM customer)", "FROM customer WHERE c_custkey % 10 <> 9)")

_FINDING_RULES = [r for r in fv.RULES if not r.startswith(("DECL", "RT"))]

FINDINGS = f"""
rule_list AS (
  SELECT unnest({sql_list(_FINDING_RULES)}) AS rule_id, unnest(range({len(_FINDING_RULES)})) AS i,
    unnest({sql_list([fv.RULES[r][2] for r in _FINDING_RULES])}) AS default_severity),
findings0 AS (
  SELECT a.id AS agent_id, a.path, a.key, r.i, r.rule_id,
    CASE WHEN r.rule_id = 'SEC002' THEN (['high', 'critical'])[a.key % 2 + 1] ELSE r.default_severity END AS severity,
    ({sql_list(fv.CONFIDENCES)})[(a.key + r.i) % 3 + 1] AS confidence,
    CAST(a.key % 90 + r.i + 1 AS INTEGER) AS line,
    CASE WHEN r.rule_id = 'AI002' THEN (['exec', 'sql', 'markup'])[a.key % 3 + 1]
         WHEN r.rule_id = 'AI005' THEN (['floating-alias', 'trust-remote-code', 'insecure-endpoint'])[a.key % 3 + 1] END AS variant,
    (a.key + r.i) % 11 = 0 AS suppressed
  FROM agents a JOIN rule_list r ON (a.key * 7 + r.i * 11) % 13 < 2),
findings AS (
  SELECT *, coalesce(variant = 'exec' AND key % 2 = 0, false) AS gate_eligible,
    substr(sha256(rule_id || ':' || path || ':' || line), 1, 16) AS fingerprint
  FROM findings0)"""

DECLARED = f"""
declared_raw AS (
  SELECT c_custkey AS dkey, 'a' || c_custkey AS agent_id, c_name AS name, 'team-' || c_nationkey AS owner,
    CASE WHEN c_custkey % 6 <> 0 THEN 'serves ' || lower(c_mktsegment) END AS purpose,
    (['internal', 'customers', 'public', 'robots', 'internal'])[c_custkey % 5 + 1] AS users,
    CASE WHEN c_custkey % 5 <> 0 THEN 'N' || c_nationkey END AS geography,
    {sql_case('c_mktsegment', d.SEGMENT_STATUS)} AS production_status,
    {sql_case('c_mktsegment', d.SEGMENT_INTENT)} AS autonomy_intent,
    {chosen(fv.DATA_CLASSES + ['secrets'], 'c_custkey', 3, 5, 4, 1)} AS data_classes,
    CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS max_per_action,
    CASE WHEN c_acctbal > 0 THEN c_acctbal / 20 END AS daily,
    CASE WHEN c_acctbal > 0 THEN CASE WHEN c_custkey % 10 = 7 THEN 'EUR' ELSE 'USD' END END AS limit_currency
  FROM customer WHERE c_custkey % 4 <> 3),
declared AS (
  SELECT * REPLACE (
    CASE WHEN users IN {sql_in(fv.USERS_VALUES)} THEN users END AS users,
    CASE WHEN production_status IN {sql_in(fv.PRODUCTION_STATUSES)} THEN production_status END AS production_status,
    CASE WHEN autonomy_intent IN {sql_in(fv.AUTONOMY_INTENTS)} THEN autonomy_intent END AS autonomy_intent,
    list_filter(data_classes, lambda x: x <> 'secrets') AS data_classes)
  FROM declared_raw)"""


def with_views(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


def _filled_sql(template: str) -> str:
    from auditspark.sources.code_corpus import unescaped

    out, rest = [], template
    holes = {"{K}": "k", "{C}": "c", "{H}": "h", "{D}": "'-'"}
    while rest:
        at = {hole: rest.find(hole) for hole in holes if hole in rest}
        if not at:
            out.append("'" + unescaped(rest).replace("'", "''") + "'")
            break
        hole = min(at, key=at.get)
        if at[hole]:
            out.append("'" + unescaped(rest[:at[hole]]).replace("'", "''") + "'")
        out.append(holes[hole])
        rest = rest[at[hole] + len(hole):]
    return "(" + " || ".join(out) + ")"


def _code_files() -> str:
    from auditspark.sources.code_corpus import DIRS, EXTENSIONS, SLOTS

    slots = []
    for a, b, choices in SLOTS:
        cases = " ".join(f"WHEN {i} THEN {_filled_sql(t)}" for i, t in enumerate(choices))
        slots.append(f"CASE (o_orderkey * {a} + o_custkey * {b}) % {len(choices)} {cases} END")
    body = " || chr(10) || ".join(slots)
    return f"""
order_keys AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c,
    substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 36) AS h FROM orders),
raw_files AS (
  SELECT ({sql_list(DIRS)})[o_custkey % {len(DIRS)} + 1] || '/m' || (o_custkey % 20) || '/f' || k || '.'
      || ({sql_list(EXTENSIONS)})[o_orderkey % {len(EXTENSIONS)} + 1] AS path, {body} AS content
  FROM order_keys),
files AS (
  SELECT path, content, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language,
    path LIKE 'tests/%' AS is_testlike
  FROM raw_files WHERE path NOT LIKE 'vendor/%' AND path NOT LIKE '%.txt'),
lines AS (
  SELECT path, is_testlike, unnest(string_split(content, chr(10))) AS text,
    unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line
  FROM files)"""


CODE = _code_files()
