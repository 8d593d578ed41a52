"""Parts that several steps read are stored once: the changes between two snapshots, facts and links of taint."""

import datetime

from auditspark.operators import flow
from auditspark.plans import queries


def _tables(spark, d):
    day = lambda y: datetime.datetime(y, 6, 1)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write([(1, "Brand#11", "SMALL TIN"), (2, "Brand#12", "SMALL TIN"), (3, "Brand#13", "TIN")], "p_partkey long, p_brand string, p_type string", "part")
    write([(1, 7, "1-URGENT"), (2, 7, "1-URGENT"), (3, 8, "1-URGENT"), (4, 9, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string", "orders")
    write([(1, 1, day(1997)), (1, 1, day(1997)), (2, 2, day(1999)), (3, 1, day(1997)), (4, 3, day(1999)), (4, 1, None)],
          "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz", "lineitem")


def test_items_and_changes_are_stored_once(spark, tmp_path):
    _tables(spark, str(tmp_path))
    base, head, agents, changes = queries._changes(spark, str(tmp_path))
    for df in (base, head, agents, changes):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "FileScan parquet" in plan and "Exchange" not in plan and "Aggregate" not in plan and "Join" not in plan
    caps = queries.derived.CAPABILITIES
    of = lambda df: {(r.agent_id, r.value) for r in df.collect() if r.kind == "capability"}
    assert of(base) == {("a35", caps[11]), ("a40", caps[11])} and of(head) == {("a35", caps[12]), ("a45", caps[13])}
    assert base.count() == 4 and head.count() == 4
    assert {(r.id, r.status) for r in agents.collect()} == {("a35", "common"), ("a40", "removed"), ("a45", "added")}
    assert {(r.value, r.change) for r in changes.collect() if r.kind == "capability"} == {(caps[11], "removed"), (caps[12], "added")}

def test_facts_and_links_of_taint_are_stored_as_columns(spark, files, monkeypatch):
    """Every round of the closure reads the assignments of scopes that have a source only."""
    from auditspark import session

    kept = []
    monkeypatch.setattr(session, "stored", lambda df, real=session.stored: kept.append(real(df)) or kept[-1])
    quiet = "def calm(u):\n    v = u\n    w = v\n    return w\n"
    f = files(("a.py", quiet + "def act(client):\n    out = client.chat.completions.create(model='m')\n    text = out.choices[0].message.content\n    more = text\n    return eval(more)\n"),
              ("b.py", quiet))
    facts = flow.facts(f)
    assert "FileScan parquet" in facts._jdf.queryExecution().sparkPlan().toString()
    got = flow.scan(f, facts).select("path", "line", "rule_id", "variant").collect()
    assert [tuple(r) for r in got if r.rule_id == "AI002"] == [("a.py", 9, "AI002", "exec")]
    links = next(df for df in kept if "target" in df.columns)
    assert {(r.path, r["name"], r.target) for r in links.collect()} == {("a.py", "client", "out"), ("a.py", "out", "text"), ("a.py", "text", "more")}
