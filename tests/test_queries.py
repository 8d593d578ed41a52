"""The registered queries against their SQL at the smallest scale, and stream against batch."""

import math
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from auditspark.plans import corpus_scan
from auditspark.operators import findings
from auditspark.sources import derived
from auditspark.streaming import spans as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one per group; the driver's own check runs all of them
CHECKED = ["span_summary", "drift_summary", "rt_contradictions", "runtime_dimensions", "dimension_scores", "graph_overlay", "decl_contradictions",
           "snapshot_diff_summary", "doc_redacted", "code_line_findings", "code_candidates", "suppressions_applied", "interval_new_findings", "stream_sessions"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    without = set(queries()) - set(oracle_sql())
    assert {name for name in without if not re.match(r"op\d+_|pipeline$", name)} == {"autonomy_ladder"}


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_stream_equals_batch(spark, sf):
    given = derived.spans(spark, sf).where("agent_id is not null")
    batch = streams.daily_totals_of(given)
    stream = streams.run(streams.daily_totals_of(streams.stream_events(spark, sf).where("agent_id is not null")), "complete")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_stream_alerts_and_dedupe_run(spark, sf):
    alerts = streams.run(streams.unapproved_alerts(streams.stream_events(spark, sf)), "append")
    assert alerts.count() > 0
    assert streams.run(streams.deduplicated(streams.stream_events(spark, sf)).select("span_id"), "append").count() == 1000


def test_whole_scan_is_deterministic_and_consistent(spark, files):
    text = ("from langchain.agents import AgentExecutor\nimport stripe\nops = AgentExecutor(tools=[pay])\n@tool\ndef pay(v):\n    stripe.Refund.create(v)\n"
            "def act(llm):\n    plan = llm.invoke('x')\n    exec(plan)\n# auditspark: ignore[AI002] known\nexec(plan)\n")
    f = files(("src/a.py", text), ("src/b.py", "x = 1\n"))
    one, two = corpus_scan.scan(f), corpus_scan.scan(f)
    key = lambda s: sorted(map(str, s.findings.collect()))
    assert key(one) == key(two)
    agent = one.agents.first()
    assert (agent.symbol, agent.confidence, agent.autonomy_level) == ("ops", "medium", "unrestricted_autonomous")
    rules = {r.rule_id for r in one.findings.collect()}
    assert {"AI002", "AI003", "CTRL001", "CTRL006"} <= rules
    assert findings.gate_trips(findings.gate(one.findings, __import__("auditspark.settings", fromlist=["Settings"]).Settings(fail_on="critical")))
    scores = {r.dimension: r.score for r in corpus_scan.assess(one).collect()}
    assert scores["output-fidelity"] >= 40 and len(scores) == 8
