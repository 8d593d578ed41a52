"""The fused aggregate of spans: one scan for every rule, and the same numbers as plain loops over the spans."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from auditspark import fixed_values as fv
from auditspark.operators import runtime_rules
from auditspark.operators import spans as S
from auditspark.sources.traces import with_times

SCHEMA = """trace_file string, trace_line long, trace_id string, span_id string, kind string, agent_id string, agent_hint struct<module:string,qualname:string>,
start_ts string, end_ts string, status string, redaction string, capability string, integration string, provider string, model string,
amount struct<amount:double,currency:string>, approval_span_id string, to_agent_id string"""


def scans(spark, run, table):
    """How many scans of *table* the executed plans of *run* hold."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    found, executions = 0, store.executionsList()
    for i in range(before, executions.size()):
        text = executions.apply(i).physicalPlanDescription()
        tree = text.split("== Initial Plan ==")[0]
        for number in set(re.findall(r"Scan parquet\s+\((\d+)\)", tree)):
            details = re.search(rf"\n\({number}\) Scan parquet.*?\n\n", text, re.S)
            found += f"/{table}.parquet" in details[0]
    return found


@pytest.mark.parametrize("name", ["rt_contradictions", "drift_summary", "merge_coverage", "graph_overlay", "unmatched_summaries"])
def test_events_and_customers_are_scanned_once(spark, sf, name):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)

    def run():
        queries()[name](spark, sf).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)

    assert scans(spark, run, "events") == 1
    assert scans(spark, run, "customer") == 1


@pytest.fixture(scope="module")
def rows():
    rnd, caps = random.Random(7), [*list(fv.CAPABILITY_PATTERNS)[:6], "", None]
    out = []
    for i in range(600):
        f, line = f"f{rnd.randrange(12)}.jsonl", i + 1
        amount = (rnd.choice([5.0, 5.0, 7.25, -3.5, 0.0]), rnd.choice(["USD", "EUR", "", None])) if rnd.random() < 0.4 else None
        agent = rnd.choice(["a1", "a2", "a3", "", None])
        out.append((f, line, "t", f"s{i}", rnd.choice(["action", "tool_call", "approval", "delegation"]), agent, (rnd.choice(["m", "", None]), "q"),
                    f"2024-01-{rnd.randrange(1, 29):02}T00:00:00.000Z", f"2024-02-{rnd.randrange(1, 29):02}T00:00:00.000Z", rnd.choice(["ok", "error", "", None]),
                    rnd.choice(["redacted", "content", None]), rnd.choice(caps), "mail", "p", rnd.choice(["x", ""]), amount, rnd.choice(["", None, "s1"]), rnd.choice(["a9", "", None])))
    return out


def test_facts_equal_loops(spark, rows):
    facts = S.facts(with_times(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    by = defaultdict(list)
    for r in rows:
        by[r[5] or None].append(r)
    high = lambda r: r[11] in fv.HIGH_IMPACT_CAPABILITIES and r[4] in ("action", "tool_call")
    place = lambda r: (r[0], r[1], r[3])
    order = {f: i for i, f in enumerate(sorted({r[0] for r in rows}))}
    got = {r.agent_id: r for r in S.summarize(facts).collect()}
    assert set(got) == set(by)
    for agent, mine in by.items():
        g = got[agent]
        assert (g.span_count, g.errors, g.n_action, g.n_delegation) == (len(mine), sum(r[9] == "error" for r in mine), *(sum(r[4] == k for r in mine) for k in ("action", "delegation")))
        assert (g.high_impact_actions, g.high_impact_approved) == (sum(map(high, mine)), sum(high(r) and bool(r[16]) for r in mine))
        assert g.max_amount == max(r[15][0] for r in mine if r[15])
    given = facts.given().stored()
    amounts = {r.agent_id: tuple(r[1:]) for r in S.max_amount_spans(given).collect()}
    unapproved = {r.agent_id: tuple(r[1:]) for r in S.first_unapproved(given).collect()}
    caps = {(r.agent_id, r.capability): tuple(r[2:]) for r in S.first_capability_spans(given).collect()}
    for agent in ("a1", "a2", "a3"):
        mine = sorted(by[agent], key=lambda r: (order[r[0]], r[1]))
        best = max((r for r in mine if r[15]), key=lambda r: (r[15][0], -order[r[0]], -r[1]))
        assert amounts[agent] == (best[15][0], best[15][1] or "USD", *place(best))
        assert unapproved[agent] == place(next(r for r in mine if high(r) and not r[16]))
        for c in {r[11] for r in mine if r[11]}:
            assert caps[agent, c] == place(next(r for r in mine if r[11] == c))
    counts = {(r.agent_id, r.dim, r.value): r.n for r in S.value_counts(given).collect()}
    assert counts == Counter((r[5], d, r[i]) for r in rows if r[5] for d, i in (("kind", 4), ("status", 9), ("capability", 11), ("integration", 12), ("provider", 13), ("model", 14)) if r[i] or d == "status" and r[i])
    assert {tuple(r) for r in S.delegations(given).collect()} == {(r[5], r[17]) for r in rows if r[5] and r[4] == "delegation" and r[17]}


def test_unmatched_spans_have_a_whole_summary(spark, rows):
    facts = S.facts(with_times(spark.createDataFrame(rows, SCHEMA))).stored()
    ids = spark.createDataFrame([("a1",), ("zz",)], "id string")
    got = {r.key: r for r in S.unmatched(S.classify(facts, ids)).collect()}
    name = lambda r: f"unknown-id:{r[5]}" if r[5] else f"{r[6][0] or 'unknown'}:q"
    want = Counter(name(r) for r in rows if r[5] != "a1")
    assert {k: r.span_count for k, r in got.items()} == want
    assert all(r.errors == sum(x[9] == "error" for x in rows if x[5] != "a1" and name(x) == k) for k, r in got.items())
    assert S.unmatched(S.classify(facts, None)).where("key like 'unknown-id%'").count() == 0


def test_a_rule_that_is_off_is_silent(spark, rows):
    from auditspark.settings import Settings

    facts = S.facts(with_times(spark.createDataFrame(rows, SCHEMA))).given().stored()
    agents = spark.createDataFrame([("a1", "p.py", 1, "human_approved", None), ("a7", "q.py", 2, "x", ["mail"])], "id string, path string, line int, autonomy_level string, capabilities array<string>")
    declared = spark.createDataFrame([("a1", "human_approved", "production", ((1.0, "USD"), (1.0, None))), ("a7", None, "production", None)],
                                     "agent_id string, autonomy_intent string, production_status string, economic_authority struct<max_per_action:struct<amount:double,currency:string>,daily_aggregate:struct<amount:double,currency:string>>")
    seen = runtime_rules.subjects(agents, declared)
    rules = lambda **s: {(r.rule_id, r.agent_id) for r in runtime_rules.detect(seen, facts, Settings(**s)).collect()}
    assert {("RT001", "a1"), ("RT002", "a1"), ("RT003", "a1"), ("RT004", "a7")} <= rules()
    assert not {r for r, _ in rules(enabled={"RT003": False, "RT004": False})} & {"RT003", "RT004"}
    assert runtime_rules.detect(seen, facts).where(F.col("rule_id") == "RT001").first().ref_span is not None
