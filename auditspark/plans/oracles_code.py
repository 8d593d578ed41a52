"""SQL for the checks on the derived code corpus, on intervals, feeds and streams."""

from auditspark import fixed_values as fv
from auditspark.operators.features import REPO_CONTROLS
from auditspark.operators.findings import DIRECTIVE_MARKER
from auditspark.plans.oracle_views import AGENTS, CODE, DECLARED, FINDINGS, ISO, SPANS, sql_case, sql_in, sql_list, with_views
from auditspark.plans.oracles import APPROVED, GIVEN, SNAP, SQL
from auditspark.plans.queries import OWNERS


def q(pattern: str) -> str:
    """A pattern as a SQL text literal, without the look-behind the engine lacks."""
    p = pattern.replace("(?:_|(?=[A-Z]))", "_").replace(r"(?<![\w.])", r"(?:^|[^\w.])").replace(r"(?<![A-Za-z0-9])", "").replace(r"(?![A-Za-z0-9])", "")
    return "'" + p.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def before(text: str, pattern: str) -> str:
    """The text in front of the first match."""
    flags = ""
    for f in ("(?im)", "(?i)", "(?m)"):
        if pattern.startswith(f):
            flags, pattern = f, pattern[len(f):]
            break
    return f"regexp_extract({text}, {q(flags + '^((?s:.*?))(?:' + pattern + ')')}, 1)"


def line_of(text: str, pattern: str) -> str:
    return f"CAST(length({before(text, pattern)}) - length(replace({before(text, pattern)}, chr(10), '')) + 1 AS INTEGER)"


def names(text: str, patterns: dict) -> str:
    parts = ", ".join(f"CASE WHEN {has(text, patterns[n])} THEN '{n}' END" for n in sorted(patterns))
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def norm(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def fp(*parts: str) -> str:
    return "substr(sha256(" + " || ':' || ".join(parts) + "), 1, 16)"


SQL["corpus_files"] = with_views(CODE, body="""
SELECT path, CASE WHEN path LIKE 'vendor/%' THEN NULL WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language,
  CASE WHEN path NOT LIKE 'vendor/%' THEN path LIKE 'tests/%' END AS is_testlike,
  CASE WHEN path LIKE 'vendor/%' THEN 'excluded by default or configured ignore pattern' END AS reason
FROM raw_files WHERE path NOT LIKE '%.txt'""")

# ------------------------------------------------------------------ line findings

REDACTED = "substr({t}, 1, 6) || '…[REDACTED:' || substr(sha256({t}), 1, 12) || ']'"
SECRET_GROUP = r"(?:^|[^A-Za-z0-9])(" + fv.SECRET.replace(r"(?<![A-Za-z0-9])", "").replace(r"(?![A-Za-z0-9])", "") + ")"
LINES = f"""
sec AS (SELECT path, line, text, is_testlike, list_distinct(regexp_extract_all(text, {q(SECRET_GROUP)}, 1)) AS toks FROM lines),
shown_lines AS (
  SELECT path, line, text, is_testlike, toks, regexp_matches(text, {q(fv.COMMENT_LINE)}) AS comment,
    CASE WHEN len(toks) = 0 THEN text WHEN len(toks) = 1 THEN replace(text, toks[1], {REDACTED.format(t='toks[1]')})
         ELSE replace(replace(text, toks[1], {REDACTED.format(t='toks[1]')}), toks[2], {REDACTED.format(t='toks[2]')}) END AS safe,
    string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS following,
    lead(text) OVER (PARTITION BY path ORDER BY line) AS next_text
  FROM sec),
tok AS (SELECT path, line, text, is_testlike, comment, safe, unnest(toks) AS t FROM shown_lines WHERE len(toks) > 0),
tok_ch AS (SELECT path, line, t, count(*) / length(t) AS p FROM (SELECT path, line, t, unnest(string_split(t, '')) AS ch FROM tok) GROUP BY path, line, t, ch),
tok_e AS (SELECT path, line, t, -sum(p * log2(p)) AS e FROM tok_ch GROUP BY path, line, t),
pwd0 AS (SELECT *, regexp_extract(text, {q(fv.PASSWORD_ASSIGNMENT)}, 2) AS v FROM shown_lines WHERE {has('text', fv.PASSWORD_ASSIGNMENT)}),
pwd AS (SELECT * FROM pwd0 WHERE v <> '' AND NOT {has('text', fv.PASSWORD_SAFE)} AND NOT {has('v', fv.PLACEHOLDER)} AND lower(v) NOT IN {sql_in(fv.PASSWORD_WORDS)}
    AND v[1] NOT IN ('$', '{{', '%', '<') AND v NOT LIKE '%${{%' AND v NOT LIKE '%{{}}%'),
pwd_ch AS (SELECT path, line, v, count(*) / length(v) AS p FROM (SELECT path, line, v, unnest(string_split(v, '')) AS ch FROM pwd) GROUP BY path, line, v, ch),
pwd_e AS (SELECT path, line, v, -sum(p * log2(p)) AS e FROM pwd_ch GROUP BY path, line, v),
hosts AS (SELECT *, list_filter(regexp_extract_all(text, {q(fv.HTTP_URL)}, 1), lambda h: NOT regexp_matches(h, {q(fv.LOCAL_HOST)}))[1] AS host FROM shown_lines WHERE NOT comment AND NOT is_testlike),
hits AS (
  SELECT path, line, strpos(text, t) AS col, 'SEC001' AS rule_id, 'critical' AS severity,
    CASE WHEN {has('t', fv.PLACEHOLDER)} OR {has('text', fv.PLACEHOLDER)} OR e < 3.0 OR comment THEN 'low' WHEN is_testlike THEN 'medium' ELSE 'high' END AS confidence, {norm('safe')} AS snippet
    FROM tok JOIN tok_e USING (path, line, t)
  UNION ALL SELECT path, line, length({before('text', fv.PASSWORD_ASSIGNMENT)}) + 1, 'SEC002', CASE WHEN comment OR is_testlike OR e < 2.0 THEN 'high' ELSE 'critical' END,
    CASE WHEN comment OR is_testlike OR e < 2.0 THEN 'low' ELSE 'high' END, {norm('replace(safe, v, ' + REDACTED.format(t='v') + ')')} FROM pwd JOIN pwd_e USING (path, line, v)
  UNION ALL SELECT path, line, coalesce({', '.join(f"CASE WHEN {has('text', p)} THEN length({before('text', p)}) + 1 END" for p in fv.SQL_INTERPOLATION)}), 'SEC003', 'high',
    CASE WHEN is_testlike THEN 'low' ELSE 'medium' END, {norm('safe')} FROM shown_lines WHERE NOT comment AND ({' OR '.join(has('text', p) for p in fv.SQL_INTERPOLATION)})
  UNION ALL SELECT path, line, strpos(text, 'http://' || host), 'NET001', 'low', 'medium', {norm('safe')} FROM hosts WHERE host IS NOT NULL
  UNION ALL SELECT path, line, length({before('text', fv.OUTGOING_CALL)}) + 1, 'NET002', 'medium', 'low', {norm('safe')} FROM shown_lines
    WHERE NOT comment AND {has('text', fv.OUTGOING_CALL)} AND NOT {has('following', fv.TIMEOUT_ARG)}
  UNION ALL SELECT path, line, 1, 'REL001', 'low', 'high', {norm('safe')} FROM shown_lines
    WHERE NOT is_testlike AND path LIKE '%.py' AND regexp_matches(text, '^[ \\t]*except\\b[^:]*:\\s*(?:#.*)?$') AND regexp_matches(next_text, '^[ \\t]+pass\\b')
      AND length(regexp_extract(next_text, '^([ \\t]*)', 1)) > length(regexp_extract(text, '^([ \\t]*)', 1))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id, snippet ORDER BY line, col) - 1 AS nth FROM hits),
core AS (
  SELECT path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column", rule_id, severity, confidence, snippet,
    {fp('rule_id', 'path', "(snippet || CASE WHEN nth > 0 THEN '#' || nth ELSE '' END)")} AS fingerprint, NULL AS variant FROM numbered)"""
SQL["code_line_findings"] = with_views(CODE, LINES, body='SELECT path, line, "column", rule_id, severity, confidence, snippet, fingerprint FROM core')

# ------------------------------------------------------------------ supply chain

ONE_PRETRAINED = r"\bfrom_pretrained\s*\(\s*'([^']+)'([^)]*)\)"
ONE_MODEL = r"\bmodel\s*[:=]\s*'([A-Za-z0-9][\w.:\-/]*)'"
CHAIN = f"""
downloads AS (SELECT path FROM files WHERE {' OR '.join(f"contains(content, '{h}')" for h in fv.DOWNLOAD_HINTS)}),
model_lines AS (SELECT path, line, is_testlike, unnest(regexp_extract_all(text, {q(ONE_MODEL)}, 1)) AS m FROM lines WHERE {has('text', ONE_MODEL)}),
chain0 AS (
  SELECT path, line, 'trust-remote-code' AS variant, 'high' AS severity, 'high' AS confidence, trim(text) AS snippet, 'trust-remote-code:' || line AS context FROM lines WHERE {has('text', fv.TRUST_REMOTE_CODE)}
  UNION ALL SELECT path, line, 'unpinned-artifact', 'medium', 'medium', regexp_extract(text, {q(ONE_PRETRAINED)}, 0), 'unpinned-artifact:' || regexp_extract(text, {q(ONE_PRETRAINED)}, 1)
    FROM lines WHERE {has('text', ONE_PRETRAINED)} AND NOT regexp_matches(regexp_extract(text, {q(ONE_PRETRAINED)}, 2), {q(fv.REVISION_KW)})
  UNION ALL SELECT path, line, 'unpinned-artifact', 'medium', 'medium', trim(text), 'unpinned-load:' || line FROM lines WHERE {has('text', fv.UNSAFE_LOAD)} AND path IN (SELECT path FROM downloads)
  UNION ALL SELECT path, min(line), 'floating-alias', 'low', 'low', 'model=''' || m || '''', 'floating-alias:' || m FROM model_lines
    WHERE NOT is_testlike AND (m LIKE '%-latest' OR m IN {sql_in(fv.FLOATING_ALIASES)}) GROUP BY path, m
  UNION ALL SELECT path, line, 'insecure-endpoint', 'medium', 'high', regexp_extract(text, {q(fv.BASE_URL)}, 0), 'insecure-endpoint:' || line FROM lines
    WHERE {has('text', fv.BASE_URL)} AND regexp_matches(regexp_extract(text, {q(fv.BASE_URL)}, 1), {q(fv.BASE_URL_HTTP)})
      AND NOT regexp_matches(regexp_extract(regexp_extract(text, {q(fv.BASE_URL)}, 1), {q(fv.BASE_URL_HTTP)}, 1), {q(fv.LOCAL_HOST)})),
chain AS (SELECT path, CAST(line AS INTEGER) AS line, variant, severity, confidence, snippet, {fp("'AI005'", 'path', 'context')} AS fingerprint FROM chain0)"""
SQL["code_supply_chain"] = with_views(CODE, CHAIN, body="SELECT * FROM chain")

# ------------------------------------------------------------------ features and candidates

CONTROLS = {
    "approval": fv.APPROVAL, "authentication": fv.CONTROL_PATTERNS["CTRL001"], "validation": fv.CONTROL_PATTERNS["CTRL002"],
    "rate_limit": fv.CONTROL_PATTERNS["CTRL003"], "observability": fv.OBSERVABILITY,
    "deterministic_sampling": fv.DETERMINISTIC_TEMPERATURE, "pinned_model": fv.DATED_SNAPSHOT}
_SITES = ", ".join(
    f"CASE WHEN {has('content', p)} THEN '{n}=' || len(regexp_extract_all(content, {q(p)})) END" for n, p in sorted(fv.INTEGRATION_PATTERNS.items()))
FEATURES = f"""
feats AS (
  SELECT path, {names('content', fv.PROVIDER_PATTERNS)} AS providers, {names('content', fv.CAPABILITY_PATTERNS)} AS capabilities,
    {names('content', fv.PERMISSION_PATTERNS)} AS tags, list_filter([{_SITES}], lambda x: x IS NOT NULL) AS sites, {names('content', CONTROLS)} AS controls
  FROM files)"""
SQL["code_features"] = with_views(CODE, FEATURES, body="""
SELECT path, array_to_string(providers, ',') AS providers, array_to_string(capabilities, ',') AS capabilities,
  array_to_string(CASE WHEN list_has_any(capabilities, ['email_send', 'messaging']) THEN list_sort(list_append(tags, 'communicate')) ELSE tags END, ',') AS permission_tags,
  array_to_string(sites, ',') AS call_sites, array_to_string(controls, ',') AS controls FROM feats""")
SQL["corpus_controls"] = with_views(CODE, body="SELECT " + ", ".join(f"bool_or({has('content', p)}) AS {n}" for n, p in REPO_CONTROLS.items()) + " FROM files")


def first_of(patterns) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {has('content', p)} THEN {line_of('content', p)} END" for p in patterns) + ")"


CALLS = f"len(regexp_extract_all(content, {q(fv.MODEL_CALL_FOR_FLOW)}))"
CANDIDATES = f"""
sig AS (
  SELECT path, content, is_testlike, {names('content', fv.FRAMEWORK_PATTERNS)} AS frameworks, {has('content', fv.AGENT_EXECUTION)} AS execution,
    {has('content', fv.PROVIDER_CALL)} OR {has('content', fv.LITELLM_CALL)} OR {has('content', fv.DIRECT_MODEL_ENDPOINT)} AS call,
    {has('content', fv.TOOL_SCHEMA)} AS tools, {' OR '.join(has('content', p) for p in fv.PROVIDER_PATTERNS.values())} AS imported,
    list_filter(regexp_extract_all(content, {q(fv.AGENT_CLASS)}, 1), lambda c: NOT regexp_matches(c, {q(fv.GENERIC_AGENT_NAME)})) AS classes, {CALLS} AS calls FROM files),
scored AS (
  SELECT *, CAST(len(frameworks) * 5 + CASE WHEN execution THEN 3 ELSE 0 END + CASE WHEN call THEN 2 ELSE 0 END + CASE WHEN tools THEN 2 ELSE 0 END + CASE WHEN imported THEN 1 ELSE 0 END
    + CASE WHEN len(classes) > 0 THEN 1 ELSE 0 END + CASE WHEN calls >= 2 THEN 2 ELSE 0 END - CASE WHEN is_testlike THEN 3 ELSE 0 END AS INTEGER) AS detection_score
  FROM sig WHERE len(frameworks) > 0 OR execution OR tools OR len(classes) > 0 OR calls >= 2),
kept AS (
  SELECT *, CASE WHEN detection_score >= 8 THEN 'high' WHEN detection_score >= 5 THEN 'medium' ELSE 'low' END AS confidence,
    list_distinct(list_filter(regexp_extract_all(content, {q(fv.AGENT_CONSTRUCTOR_ASSIGNMENT)}, 1), lambda c: NOT regexp_matches(c, {q(fv.GENERIC_AGENT_NAME)}))) AS made,
    list_distinct(list_filter(regexp_extract_all(content, {q(fv.AGENT_LIKE_VARIABLE)}, 1), lambda c: NOT regexp_matches(c, {q(fv.GENERIC_AGENT_NAME)}))) AS vars,
    regexp_extract(content, {q(fv.AGENT_FACTORY_FUNCTION)}, 1) AS factory
  FROM scored WHERE detection_score >= 3 OR len(frameworks) > 0),
cand AS (
  SELECT path, content, is_testlike, confidence, detection_score, frameworks, unnest(CASE WHEN len(made) > 0 THEN made WHEN len(classes) > 0 THEN [classes[1]] WHEN len(vars) > 0 THEN vars
      WHEN factory <> '' AND NOT regexp_matches(factory, {q(fv.GENERIC_AGENT_NAME)}) THEN [factory] ELSE [regexp_extract(path, '([^/]+)\\.[^.]*$', 1)] END) AS symbol,
    CASE WHEN len(frameworks) > 0 THEN {first_of(fv.FRAMEWORK_PATTERNS.values())} WHEN execution THEN {line_of('content', fv.AGENT_EXECUTION)}
         WHEN call THEN {first_of([fv.PROVIDER_CALL, fv.LITELLM_CALL, fv.DIRECT_MODEL_ENDPOINT])} WHEN tools THEN {line_of('content', fv.TOOL_SCHEMA)}
         WHEN imported THEN {first_of(fv.PROVIDER_PATTERNS.values())}
         WHEN len(classes) > 0 THEN {line_of('content', r'class\s+(\w*Agent\w*)')} ELSE 1 END AS line
  FROM kept),
agents_c AS (SELECT substr(sha256(path || ':' || symbol), 1, 12) AS id, * FROM cand)"""
SQL["code_candidates"] = with_views(CODE, CANDIDATES, body="SELECT id, symbol, path, confidence, detection_score, array_to_string(frameworks, ',') AS frameworks, line FROM agents_c")


def title(rule):
    return "'" + fv.RULES[rule][0].replace("'", "''") + " for candidate ' || symbol"


_HI = {c: fv.CAPABILITY_PATTERNS[c] for c in fv.HIGH_IMPACT_CAPABILITIES}
_IN_CORPUS = {r: f"(SELECT bool_or({has('content', fv.CONTROL_PATTERNS[r])}) FROM files)" for r in fv.CONTROL_NAMES}
PROMPTS = f"""
flagged AS (SELECT *, {has('content', fv.TOOL_BINDING)} AS tool, len({names('content', _HI)}) > 0 AS hi FROM agents_c WHERE confidence <> 'low'),
prompts0 AS (
  {' UNION ALL '.join(f"SELECT id, path, line, '{r}' AS rule_id, 'info' AS severity, {title(r)} AS snippet, {title(r)} AS context FROM flagged WHERE NOT {has('content', fv.CONTROL_PATTERNS[r])} AND NOT {_IN_CORPUS[r]}" for r in fv.CONTROL_NAMES)}
  UNION ALL SELECT id, path, line, 'AI003', 'info', 'high-impact capability for candidate ' || symbol, 'AI003:' || symbol FROM flagged WHERE tool AND hi AND NOT {has('content', fv.APPROVAL)}
  UNION ALL SELECT id, path, line, 'AI007', 'info', 'sampling config for candidate ' || symbol, 'AI007:' || symbol FROM flagged
    WHERE hi AND {has('content', fv.MODEL_CALL_SITE)} AND NOT {has('content', fv.DETERMINISTIC_TEMPERATURE)}
  UNION ALL SELECT id, path, line, 'CTRL004', 'info', 'observability for candidate ' || symbol, 'CTRL004:' || symbol FROM flagged
    WHERE tool AND NOT {has('content', fv.OBSERVABILITY)} AND NOT (SELECT bool_or({has('content', fv.OBSERVABILITY)}) FROM files))"""
SQL["code_prompts"] = with_views(CODE, CANDIDATES, PROMPTS, body=f"""
SELECT id AS agent_id, path, line, rule_id, severity, snippet, {fp('rule_id', 'path', 'context')} AS fingerprint FROM prompts0""")

# ------------------------------------------------------------------ suppression, superseding, documents

DIRECTIVE = r"(?:#|//)\s*" + DIRECTIVE_MARKER + r":\s*(ignore-file|ignore)\[([^\]]*)\]\s*(.*?)\s*$"
MARKS = f"""
marks AS (
  SELECT path, line, regexp_extract(text, {q(DIRECTIVE)}, 1) AS scope, nullif(regexp_extract(text, {q(DIRECTIVE)}, 3), '') AS reason, regexp_matches(text, '^\\s*(?:#|//)') AS alone,
    trim(unnest(string_split(regexp_extract(text, {q(DIRECTIVE)}, 2), ','))) AS rule_id
  FROM lines WHERE {has('text', DIRECTIVE)}),
targets AS (SELECT path, rule_id, unnest(CASE WHEN alone THEN [line, line + 1] ELSE [line] END) AS line, line AS src_line, reason FROM marks WHERE rule_id IN {sql_in(list(fv.RULES))} AND scope = 'ignore'),
first_target AS (SELECT * FROM targets QUALIFY row_number() OVER (PARTITION BY path, rule_id, line ORDER BY src_line) = 1),
all_core AS (SELECT path, line, "column", rule_id, severity, confidence, snippet, fingerprint, variant FROM core UNION ALL SELECT path, line, 1, 'AI005', severity, confidence, snippet, fingerprint, variant FROM chain)"""
SQL["suppressions_applied"] = with_views(CODE, LINES, CHAIN, MARKS, body="""
SELECT c.path, c.line, c.rule_id, c.fingerprint, t.path IS NOT NULL AS suppressed, t.reason AS suppression_reason
FROM all_core c LEFT JOIN first_target t ON t.path = c.path AND t.rule_id = c.rule_id AND t.line = c.line""")
SQL["suppression_warnings"] = with_views(CODE, LINES, CHAIN, MARKS, body=f"""
SELECT path, CAST(line AS INTEGER) AS line, rule_id, 'unknown rule id' AS problem FROM marks WHERE rule_id NOT IN {sql_in(list(fv.RULES))}""")
SQL["superseded"] = with_views(CODE, LINES, CHAIN, MARKS, """
found AS MATERIALIZED (SELECT path, line, rule_id, fingerprint, variant FROM all_core),
claims AS (SELECT DISTINCT path, line, 'NET001' AS rule_id FROM found WHERE variant = 'insecure-endpoint')""", body="""
SELECT path, line, rule_id, fingerprint FROM found ANTI JOIN claims USING (path, line, rule_id)""")
_DIMS = sql_case("CASE WHEN rule_id = 'AI005' THEN rule_id || '/' || variant ELSE rule_id END",
                 {**{r: ",".join(sorted(v)) for r, v in fv.RULE_DIMENSIONS.items()}, **{f"{r}/{v}": ",".join(sorted(d)) for (r, v), d in fv.VARIANT_DIMENSIONS.items()}})
SQL["sarif_rows"] = with_views(CODE, LINES, CHAIN, MARKS, body=f"""
SELECT rule_id AS rule, {sql_case('severity', fv.SARIF_LEVEL)} AS level, path AS uri, line AS start_line, "column" AS start_column, fingerprint, {_DIMS} AS dimensions, confidence FROM all_core""")

# ------------------------------------------------------------------ intervals and feeds

SQL["interval_new_findings"] = """
WITH ranges AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey, l_returnflag),
places AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line,
  EXISTS (SELECT 1 FROM ranges r WHERE r.l_orderkey = p.l_orderkey AND p.l_linenumber BETWEEN r.a AND r.b) AS is_new, n FROM places p"""
# the owner patterns of the query, each as the expression a reader would write for it
_OWNER_EXPR = {"*": "true", "src/": "regexp_matches(path, '(^|/)src/')", "*.ts": "path LIKE '%.ts'", "/app/m1*/": "regexp_matches(path, '^app/m1[^/]*/')",
               "tests/**": "path LIKE 'tests/%'", "lib/core/m3/*.py": "regexp_matches(path, '^lib/core/m3/[^/]*\\.py$')"}
_BY_LAST = " ".join(f"WHEN {_OWNER_EXPR[p]} THEN '{{}}'" for p, _ in reversed(OWNERS))
SQL["owners_last_match"] = with_views(CODE, body=f"""
SELECT path, CASE {_BY_LAST.format(*[p for p, _ in reversed(OWNERS)])} END AS owner_pattern, CASE {_BY_LAST.format(*[','.join(o) for _, o in reversed(OWNERS)])} END AS owners FROM files""")
SQL["attribution"] = """
WITH commits0 AS (
  SELECT 'p' || l_partkey AS path, CASE WHEN l_suppkey % 3 = 0 THEN 'renovate-' ELSE 'dev' END || l_suppkey AS author, l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem),
commits AS (SELECT path, author, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || author AS hash, date FROM commits0),
last5 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY date DESC, hash DESC) AS rn FROM commits QUALIFY rn <= 5)
SELECT path, coalesce(min_by(author, rn) FILTER (author NOT LIKE 'renovate%'), min_by(author, rn)) AS last_author, min_by(hash, rn) AS commit_hash, min_by(date, rn) AS commit_date FROM last5 GROUP BY path"""
SQL["diff_hunks"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS diff_id, 'src/f' || o_custkey AS path, CAST(o_orderkey % 90 + 1 AS INTEGER) AS start_line, CAST(o_orderkey % 90 + o_orderkey % 4 AS INTEGER) AS end_line FROM orders WHERE o_orderkey % 4 > 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'src/f' || o_custkey, o_orderkey % 70 + 200, o_orderkey % 70 + 200 FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'lib/g' || (o_orderkey % 9), o_custkey % 50 + 1, o_custkey % 50 + o_custkey % 3 + 1 FROM orders"""

# ------------------------------------------------------------------ streams

SQL["stream_daily_totals"] = with_views(SPANS, DECLARED, GIVEN, f"""
daily AS (SELECT strftime(date_trunc('day', start_at), {ISO}) AS day, agent_id, currency, CAST(sum(CAST(amount AS DECIMAL(24,4))) AS DOUBLE) AS total FROM given WHERE amount IS NOT NULL GROUP BY ALL)""", body="""
SELECT day, t.agent_id, currency, total, d.daily AS daily_limit FROM daily t JOIN declared d ON d.agent_id = t.agent_id AND d.limit_currency = t.currency WHERE total > d.daily""")
SQL["stream_agent_counters"] = with_views(SPANS, GIVEN, body=f"""
SELECT strftime(date_trunc('hour', start_at), {ISO}) AS window_start, agent_id, count(*) AS span_count, count(*) FILTER (status = 'error') AS errors,
  count(*) FILTER (hi) AS high_impact_actions, count(*) FILTER (hi AND approval_span_id IS NOT NULL) AS high_impact_approved FROM given GROUP BY ALL""")
SQL["stream_redacted"] = with_views(SPANS, body=f"""
SELECT span_id, CASE WHEN capability NOT IN {sql_in(list(fv.CAPABILITY_PATTERNS))} OR integration NOT IN {sql_in(list(fv.INTEGRATION_PATTERNS))} OR provider NOT IN {sql_in(list(fv.PROVIDER_PATTERNS))} THEN 'custom' END AS vocabulary,
  CAST(k AS VARCHAR) AS k, sha256(event_type) AS event_sha256, CAST(length(event_type) AS VARCHAR) AS event_chars FROM spans""")
SQL["stream_sessions"] = with_views(SPANS, GIVEN, f"""
marked AS (SELECT agent_id, start_at, CASE WHEN start_at < lag(start_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM given WINDOW w AS (PARTITION BY agent_id ORDER BY start_at)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY agent_id ORDER BY start_at ROWS UNBOUNDED PRECEDING) AS g FROM marked)""", body=f"""
SELECT strftime(min(start_at), {ISO}) AS session_start, strftime(max(start_at) + INTERVAL 30 MINUTE, {ISO}) AS session_end, agent_id, count(*) AS span_count FROM grouped GROUP BY agent_id, g""")
SQL["stream_approval_windows"] = with_views(SPANS, GIVEN, f"""
slid AS (SELECT *, time_bucket(INTERVAL 6 HOUR, start_at) - INTERVAL 6 HOUR * unnest([0, 1, 2, 3]) AS w FROM given WHERE hi)""", body=f"""
SELECT strftime(w, {ISO}) AS window_start, agent_id, count(*) AS actions, count(*) FILTER (approval_span_id IS NOT NULL) AS approved,
  CAST(round_even(count(*) FILTER (approval_span_id IS NOT NULL) / count(*), 4) AS DOUBLE) AS rate FROM slid GROUP BY w, agent_id""")

# ------------------------------------------------------------------ text tables and trace lines

TEXTS = r"""
files AS (
  SELECT 'documents/' || doc_id || '.py' AS path, coalesce(text, '') AS content, 'python' AS language, false AS is_testlike FROM documents
  UNION ALL SELECT 'pages/' || page_id || '.py', coalesce(html, ''), 'python', false FROM pages
  UNION ALL SELECT 'conversations/' || conv_id || '-' || turn || '.py', coalesce(text, ''), 'python', false FROM conversations),
lines AS (
  SELECT path, is_testlike, unnest(regexp_split_to_array(content, '\r?\n')) AS text,
    unnest(range(1, len(regexp_split_to_array(content, '\r?\n')) + 1)) AS line FROM files)"""
SQL["text_rule_scan"] = SQL["code_line_findings"].replace(CODE, TEXTS)
SQL["text_features"] = with_views(TEXTS, FEATURES, body="""
SELECT path, array_to_string(providers, ',') AS providers, array_to_string(capabilities, ',') AS capabilities,
  array_to_string(CASE WHEN list_has_any(capabilities, ['email_send', 'messaging']) THEN list_sort(list_append(tags, 'communicate')) ELSE tags END, ',') AS permission_tags,
  array_to_string(list_sort(list_transform(sites, lambda x: split_part(x, '=', 1))), ',') AS integrations, array_to_string(controls, ',') AS controls FROM feats
WHERE len(providers) + len(capabilities) + len(tags) + len(sites) + len(controls) > 0""")
TRACES = f"""
event_lines AS (
  SELECT *, CAST(regexp_extract(trace_file, '([0-9]+)', 1) AS BIGINT) AS number, k % 31 <> 7 AS whole, NOT (k % 31 <> 7 AND k % 37 = 11) AS filled FROM spans),
trace_files AS (SELECT DISTINCT trace_file, number, number % 6 <> 5 AS headed, number % 6 <> 5 AND number % 7 = 3 AS rejected FROM event_lines)"""
SQL["trace_rejected"] = with_views(SPANS, TRACES, body="SELECT trace_file FROM trace_files WHERE rejected")
SQL["trace_spans"] = with_views(SPANS, TRACES, body="""
SELECT trace_file, trace_line, kind, span_id, agent_id, status, capability, amount, approval_span_id, epoch_ms(start_at) AS start_ms
FROM event_lines JOIN trace_files USING (trace_file) WHERE whole AND filled AND NOT rejected""")
SQL["trace_read_stats"] = with_views(SPANS, TRACES, """
first_lines AS (SELECT trace_file, arg_min(whole, trace_line) FILTER (filled) AS first_whole FROM event_lines GROUP BY trace_file),
per_file AS (
  SELECT f.*, (SELECT count(*) FILTER (whole AND filled) FROM event_lines e WHERE e.trace_file = f.trace_file) AS good,
    (SELECT count(*) FILTER (NOT whole) FROM event_lines e WHERE e.trace_file = f.trace_file) AS bad, l.first_whole FROM trace_files f JOIN first_lines l USING (trace_file))""", body="""
SELECT count(*) FILTER (NOT rejected) AS files_read, count(*) FILTER (rejected) AS files_skipped, CAST(sum(good) FILTER (NOT rejected) AS BIGINT) AS spans_read,
  CAST(sum(bad) FILTER (NOT rejected) AS BIGINT) AS bad_lines, count(*) FILTER (NOT headed AND first_whole) AS headers_missing,
  CAST(sum(number % 4) FILTER (headed AND NOT rejected) AS BIGINT) AS dropped_spans,
  CAST(max(CASE WHEN headed AND NOT rejected AND number % 5 <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS saw_redacted,
  CAST(max(CASE WHEN headed AND NOT rejected AND number % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS saw_content FROM per_file""")

# ------------------------------------------------------------------ data flow, as expected of each snippet

# Facts that a reader counts in each choice of each slot of the code corpus, in the order of the slots: calls, plain
# assignments, functions, loops with calls. The ninth choice of the seventh slot is no Python, so its files give one `degraded` row.
EXPECTED_FACTS = [
    {"call": [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0], "assign": [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]},
    {"assign": [1, 1, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1]},
    {"call": [0, 0, 1, 0, 0, 0, 0], "assign": [1, 1, 1, 1, 1, 1, 0]},
    {"assign": [1, 1, 1, 0, 1, 1]},
    {"call": [1, 1, 1, 0, 1], "assign": [0, 0, 0, 0, 1], "function": [1, 1, 1, 1, 1]},
    {"call": [1, 2, 1, 0], "function": [1, 1, 1, 1]},
    {"call": [2, 3, 1, 2, 3, 2, 3, 0, 0, 1], "assign": [2, 2, 2, 2, 1, 1, 1, 1, 0, 0], "function": [1, 1, 1, 1, 2, 1, 1, 1, 0, 1],
     "loop": [0, 0, 0, 0, 0, 1, 1, 0, 0, 0]},
    {"call": [1, 2, 0, 0, 0, 2, 1, 2], "assign": [1, 2, 1, 1, 0, 1, 1, 1], "function": [0, 0, 0, 0, 1, 0, 0, 0]},
    {"call": [1, 2, 1, 1, 1, 1, 1, 1, 0], "assign": [0, 0, 1, 0, 1, 0, 1, 1, 1], "function": [1, 1, 0, 1, 0, 0, 0, 0, 0]},
    {"call": [1, 1, 1, 1, 1, 1, 1, 1, 2, 1], "assign": [1, 1, 1, 1, 1, 1, 1, 1, 2, 1]},
]
# choice of the seventh slot -> findings: rule, variant, severity, confidence, stops a gate, line, steps, tags
EXPECTED_FLOWS = [
    (0, "AI002", "exec", "critical", "high", True, "return eval(text)", 2, ""),
    (1, "AI002", "sql", "critical", "high", False, "cursor.execute(sql)", 3, ""),
    (2, "AI001", None, "high", "high", False, "return client.chat.completions.create(messages=[prompt])", 3, "system_role_interpolation"),
    (3, "AI004", "pii", "medium", "high", False, "return client.responses.create(input=note)", 3, ""),
    (3, "AI006", "pii", "medium", "high", False, "requests.post('https://crm{C}.net/in', json=note)", 3, ""),
    (4, "AI002", "exec", "critical", "medium", False, "os.system(cmd)", 2, ""),
]


def _choice(slot: int) -> str:
    from auditspark.sources.code_corpus import SLOTS

    a, b, choices = SLOTS[slot]
    return f"((o_orderkey * {a} + o_custkey * {b}) % {len(choices)})"


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


_FACT_SUMS = ", ".join(
    " + ".join(f"({e[kind]})[{_choice(i)} + 1]" for i, e in enumerate(EXPECTED_FACTS) if kind in e) + f" AS {kind}_n" for kind in ("call", "assign", "function", "loop"))
PARSED = f"""
python_files AS (
  SELECT path, content, o_custkey, {_choice(6)} AS choice, {_FACT_SUMS}
  FROM files JOIN orders ON o_orderkey = CAST(regexp_extract(path, '/f([0-9]+)[.]', 1) AS BIGINT) WHERE language = 'python')"""
SQL["flow_facts"] = with_views(CODE, PARSED, body=" UNION ALL ".join(
    f"SELECT '{kind}' AS kind, CAST(sum({kind}_n) AS BIGINT) AS n, count(*) FILTER ({kind}_n > 0) AS files FROM python_files WHERE choice <> 8 HAVING sum({kind}_n) > 0"
    for kind in ("call", "assign", "function", "loop")) + " UNION ALL SELECT 'degraded', count(*), count(*) FROM python_files WHERE choice = 8 HAVING count(*) > 0")
_LOCAL_MODEL = f"({has('content', fv.LOCAL_ENDPOINT)} OR {has('content', fv.PROVIDER_PATTERNS['ollama'])})"
SQL["flow_findings"] = with_views(CODE, PARSED, f"""
expected(choice, rule_id, variant, severity, confidence, gate_eligible, shown, steps, tags) AS (VALUES {', '.join(
    f"({c}, '{r}', {_text(v)}, '{s}', '{k}', {g}, {_text(t)}, {n}, '{w}')" for c, r, v, s, k, g, t, n, w in EXPECTED_FLOWS)}),
told AS (
  SELECT path, rule_id, variant, confidence, gate_eligible, replace(shown, '{{C}}', CAST(o_custkey AS VARCHAR)) AS snippet, steps,
    CASE WHEN rule_id = 'AI004' AND {_LOCAL_MODEL} THEN 'low' ELSE severity END AS severity,
    CASE WHEN rule_id = 'AI004' AND {_LOCAL_MODEL} THEN 'local_endpoint_observed' ELSE tags END AS tags
  FROM python_files JOIN expected USING (choice))""", body=f"""
SELECT t.path, CAST(l.line AS INTEGER) AS line, rule_id, variant, severity, confidence, gate_eligible, snippet, steps, tags,
  {fp('rule_id', 't.path', "concat_ws(':', rule_id, variant, snippet)")} AS fingerprint
FROM told t JOIN lines l ON l.path = t.path AND trim(l.text) = snippet""")

# ------------------------------------------------------------------ summaries and documents

SQL["stale_approvals"] = with_views(SNAP, APPROVED, body="SELECT DISTINCT agent_id, kind, value, stale_reason AS reason FROM approved WHERE stale_reason IS NOT NULL")
_LEVEL = f"list_position({sql_list(fv.CONFIDENCES)}, confidence)"
SQL["confidence_changes"] = with_views(AGENTS, f"""
moved AS (
  SELECT id, confidence, {_LEVEL} AS old, least(greatest({_LEVEL} + CASE WHEN key % 4 = 0 THEN 1 WHEN key % 7 = 0 THEN -1 ELSE 0 END, 1), {len(fv.CONFIDENCES)}) AS now FROM agents)""", body=f"""
SELECT id AS agent_id, confidence AS base, ({sql_list(fv.CONFIDENCES)})[now] AS head, CASE WHEN now > old THEN 'medium' END AS drift FROM moved WHERE now <> old""")
_COUNTS = ", ".join(f"count(*) FILTER (NOT suppressed AND severity = '{s}') AS n_{s}, count(*) FILTER (NOT suppressed AND line % 4 = 0 AND severity = '{s}') AS new_{s}" for s in fv.SEVERITIES)
SQL["registry_summary"] = with_views(AGENTS, FINDINGS, body=f"""
SELECT (SELECT count(DISTINCT path) FROM agents) AS files_scanned, (SELECT count(*) FROM agents) AS agent_candidates,
  (SELECT count(*) FILTER (confidence = 'high') FROM agents) AS high_confidence, (SELECT count(DISTINCT i) FROM (SELECT unnest(integrations) AS i FROM agents)) AS integrations,
  {_COUNTS}, count(*) FILTER (suppressed) AS suppressed_findings FROM findings""")
SQL["sarif_rules"] = with_views(AGENTS, FINDINGS, body=f"""
SELECT rule_id, {sql_case('rule_id', {r: v[0] for r, v in fv.RULES.items()})} AS title,
  array_to_string(list_filter(['security', {sql_case('rule_id', {r: v[1] for r, v in fv.RULES.items()})}, {sql_case('rule_id', {r: 'owasp-' + v[0].lower() for r, v in fv.RISK_LIST.items()})}], lambda x: x IS NOT NULL), ',') AS tags
FROM (SELECT DISTINCT rule_id FROM findings)""")
