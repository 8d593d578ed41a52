import json
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import drift, findings, snapshot
from auditspark.operators import spans as S
from auditspark.settings import Settings, SettingsError
from auditspark.sinks import tables
from auditspark.sources import corpus, declarations, feeds, traces
from auditspark.streaming import spans as streams


def span(i, **kw):
    base = {"kind": "action", "trace_id": "t", "span_id": f"s{i}", "agent_id": "a1", "start_ts": f"2026-01-01T00:00:{i:02d}.000Z",
            "end_ts": f"2026-01-01T00:00:{i:02d}.500Z", "status": "ok", "redaction": "redacted"}
    return json.dumps({**base, **kw})


HEADER = json.dumps({"kind": "header", "schema": "agent-trace/1.0", "redaction": "redacted", "dropped_spans": 2})


@pytest.fixture
def trace_dir(tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([
        HEADER, span(1, capability="payment_access", amount={"amount": 5, "currency": "USD"}), "", "not json", '{"kind": "mystery"}',
        span(2, capability="payment_access", approval_span_id="s9", amount={"amount": 5, "currency": "USD"}),
        span(3, kind="delegation", to_agent_id="a2", attrs={"note": "hello", "n": "3"})]) + "\n")
    (tmp_path / "b.jsonl").write_text(span(4, agent_id=None, agent_hint={"module": "svc.pay", "qualname": "Run.go"}) + "\n")
    (tmp_path / "c.jsonl").write_text(HEADER.replace("1.0", "9.0") + "\n" + span(5) + "\n")
    (tmp_path / "d.jsonl").write_text("broken\n" + HEADER.replace("1.0", "1.7") + "\n" + span(6) + "\n")
    return str(tmp_path)


def test_trace_reader(spark, trace_dir):
    lines = traces.read_lines(spark, trace_dir)
    got = sorted((r.trace_file, r.trace_line, r.span_id) for r in traces.spans(lines).collect())
    assert got == [("a.jsonl", 2, "s1"), ("a.jsonl", 6, "s2"), ("a.jsonl", 7, "s3"), ("b.jsonl", 1, "s4"), ("d.jsonl", 3, "s6")]
    stats = traces.read_stats(lines).first().asDict()
    assert {k: stats[k] for k in ("files_read", "files_skipped", "spans_read", "bad_lines", "headers_missing", "dropped_spans")} == {
        "files_read": 3, "files_skipped": 1, "spans_read": 5, "bad_lines": 3, "headers_missing": 1, "dropped_spans": 4}
    good, bad = streams.dead_letters(lines)
    assert bad.count() == 3


def test_lines_of_many_splits_are_numbered_as_in_one_piece(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    rows = ["" if i % 11 == 0 else f"line {i} é\r " + "x" * (i * 7919 % 90) for i in range(1, 4001)]
    (tmp_path / "big.jsonl").write_bytes("\n".join(rows).encode())
    (tmp_path / "end.jsonl").write_bytes(("\n".join(rows[:900]) + "\n").encode())
    (tmp_path / "none.jsonl").write_bytes(b"")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        got = traces.numbered_lines(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path / "big.jsonl")).select("_metadata.file_block_start").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r.trace_file, r.trace_line, r.text) for r in got) == sorted(
        [("big.jsonl", i, t) for i, t in enumerate(rows, 1)] + [("end.jsonl", i, t) for i, t in enumerate(rows[:900], 1)])


def test_hunks_of_one_large_diff_spread_over_blocks(spark):
    rnd, lines, want, file = random.Random(8), [], [], ""
    for i in range(3000):
        kind = rnd.random()
        if kind < 0.05:
            file = rnd.choice([f"src/{i}.py", ""])
            lines.append(f"+++ b/{file}" if file else "+++ /dev/null")
        elif kind < 0.5:
            start, n = rnd.randrange(1, 99), rnd.randrange(0, 3)
            lines.append(f"@@ -1 +{start},{n} @@ def f")
            if file and n:
                want.append(("d", file, start, start + n - 1))
        else:
            lines.append("+changed")
    diffs = spark.createDataFrame([("d", "\n".join(lines)), ("e", "@@ -1 +1 @@\n+++ b/q\n@@ -1 +7 @@"), ("n", None), ("z", "")], "diff_id string, text string")
    for block in (1, 64, 4096):
        assert sorted(map(tuple, findings.added_ranges(diffs, block).collect())) == sorted([*want, ("e", "q", 7, 7)])


def test_similar_sets_equal_all_pairs(spark):
    rnd = random.Random(9)
    pool = [f"h{i}" for i in range(14)]
    make = lambda k: [(f"{k}{i}", rnd.sample(pool, rnd.randint(0, 9))) for i in range(120)]
    base, head = make("b"), make("h")
    frame = lambda rows: spark.createDataFrame(rows, "id string, hashes array<string>")
    for t in (0.5, 0.8, 1.0):
        sets = lambda rows: {tuple(sorted(set(h))) for _, h in rows if h}
        want = {("|".join(x), "|".join(y)) for x in sets(base) for y in sets(head) if len({*x} & {*y}) >= t * len({*x} | {*y}) - 1e-12}
        assert {(r.base_sig, r.head_sig) for r in snapshot.similar_signatures(frame(base), frame(head), t).collect()} == want


def test_span_summary_and_refs(spark, trace_dir):
    sp = traces.spans(traces.read_lines(spark, trace_dir))
    facts = S.facts(sp).stored()
    mine = S.Facts(facts.table.where("agent_id = 'a1'"), facts.located)
    s = S.summarize(mine).first()
    assert (s.high_impact_actions, s.high_impact_approved, s.approval_rate, s.max_amount) == (2, 1, 0.5, 5.0)
    assert S.first_unapproved(mine).first()[1:] == ("a.jsonl", 2, "s1")
    assert S.max_amount_spans(mine).first()[1:] == (5.0, "USD", "a.jsonl", 2, "s1")  # the earliest wins a tie
    assert S.amount_totals(mine).first().total == 10.0
    agents = spark.createDataFrame([("x1", "n", "Run", "svc/z.py"), ("x2", "n", "q", "svc/pay.py"), ("x3", "n", "q", "svc/b.py")], "id string, name string, symbol string, path string")
    keys = S.classify(facts, agents).rows("span").where("agent_id is null").select("key")
    assert {r.agent_id for r in S.suggested_matches(keys, agents).collect()} == {"x1", "x2"}


def test_redaction_of_attributes(spark, trace_dir):
    sp = traces.spans(traces.read_lines(spark, trace_dir)).where("span_id = 's3'")
    attrs = streams.redact_spans(sp).first().attrs
    assert set(attrs) == {"note_sha256", "note_chars", "n"} and attrs["n"] == "3" and attrs["note_chars"] == "5"


def test_corpus_folder(spark, tmp_path):
    root = tmp_path / "proj"
    for name, data in {"src/a.py": b"x = 1\n", "node_modules/b.js": b"y", "src/c.txt": b"z", "src/d.min.js": b"z", "gen/e.py": b"z", "src/big.py": b"z" * 50,
                       "tests/f.py": b"ok \xff\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    files, skipped = corpus.read_folder(spark, str(root), Settings(max_file_bytes=20), gitignore=["gen/", "# note"])
    assert {(r.path, r.language, r.is_testlike) for r in files.collect()} == {("src/a.py", "python", False), ("tests/f.py", "python", True)}
    assert {(r.path, r.reason.split(" ")[0]) for r in skipped.collect()} == {
        ("node_modules/b.js", "excluded"), ("src/d.min.js", "excluded"), ("gen/e.py", "excluded"), ("src/big.py", "file")}


def test_feeds(spark, tmp_path):
    (tmp_path / "log").write_text("p.py\x1fdependabot[bot]\x1fh2\x1f2026-01-02\np.py\x1fAda\x1fh1\x1f2026-01-01\nbad line\n")
    got = findings.attribution(feeds.read_commits(spark, str(tmp_path / "log"))).first()
    assert (got.last_author, got.commit_hash) == ("Ada", "h2")
    (tmp_path / "x.diff").write_text("+++ b/a.py\n@@ -1 +3,2 @@\n+++ b/z.py\n@@ -1,2 +5,0 @@\n+++ /dev/null\n@@ -1 +1 @@\n")
    assert [(r.path, r.start_line, r.end_line) for r in findings.added_ranges(feeds.read_diffs(spark, str(tmp_path / "x.diff"))).collect()] == [("a.py", 3, 4)]
    (tmp_path / "OWNERS").write_text("# c\n* @all\nsrc/ @core\n*.md\n")
    rules = feeds.read_owners(spark, str(tmp_path / "OWNERS"))
    paths = spark.createDataFrame([("src/a.py",), ("b.py",)], "path string")
    assert {(r.path, r.owners[0]) for r in findings.owners(paths, rules).collect()} == {("src/a.py", "@core"), ("b.py", "@all")}


def test_baseline_round_trip_and_version(spark, trace_dir, tmp_path):
    b = drift.Behaviour.of(S.facts(traces.spans(traces.read_lines(spark, trace_dir))).given().stored())
    drift.write_baseline(b, str(tmp_path / "base"))
    again = drift.read_baseline(spark, str(tmp_path / "base"))
    assert sorted(again.totals.collect()) == sorted(b.totals.collect()) and again.max_amounts.count() == b.max_amounts.count() > 0
    events = drift.compute_drift(b, again)
    assert events.count() == 0
    assert drift.summarize_events(events).first().max_class == "none"
    assert not drift.drift_gate(events, "info")
    with pytest.raises(drift.BaselineVersionError):
        drift.check_version("runtime-baseline/2.0")


def test_approvals(spark, tmp_path):
    rows = [(1, "a1", "n", "capability", "v", "r", "me", None, "2020-01-01"), (2, "a1", "n", "capability", "v", "r", "me", None, None),
            (3, "a2", "n", "capability", "v", "r", "me", "other", "bad-date"), (4, "a3", "n", "capability", "v", "r", "me", "fp", None)]
    df = spark.createDataFrame(rows, declarations.APPROVALS)
    declarations.append_approval(df, str(tmp_path / "ap"))
    stored = declarations.read_approvals(spark, str(tmp_path / "ap"))
    assert {(r.ord, r.state) for r in declarations.list_approvals(stored, "2026-01-01").collect()} == {(1, "expired"), (2, "active"), (3, "active"), (4, "active")}
    entries = spark.createDataFrame([(a, "capability", "v") for a in ("a1", "a2", "a3", "a4")], "agent_id string, kind string, value string")
    fps = spark.createDataFrame([(a, "fp") for a in ("a1", "a2", "a3", "a4")], "agent_id string, fingerprint string")
    got = {r.agent_id: (r.approved, r.stale_reason) for r in snapshot.with_approval(entries, stored, fps, "2026-01-01").collect()}
    assert got == {"a1": (False, "expired"), "a2": (False, "evidence changed"), "a3": (True, None), "a4": (False, None)}


def test_registry_sink_checks_paths(spark, tmp_path):
    agents = spark.createDataFrame([("1", "src/a.py")], "id string, path string")
    good = spark.createDataFrame([("1", 2, "SEC001", "f", "src/a.py", None)], "agent_id string, line int, rule_id string, fingerprint string, path string, note string")
    tables.write_registry(agents, good, str(tmp_path / "out"))
    doc = spark.read.json(str(tmp_path / "out" / "agents")).first()
    assert doc.findings[0].rule_id == "SEC001" and "note" not in doc.findings[0].asDict()
    with pytest.raises(tables.InvalidDocument):
        tables.write_registry(agents.withColumn("path", F.lit("/abs")), good, str(tmp_path / "bad"))


def test_settings_are_checked():
    for bad in ({"enabled": {"XX999": True}}, {"severity_overrides": {"SEC001": "huge"}}, {"runtime_suppress": ("RT002",)}, {"fail_on": "maybe"}):
        with pytest.raises(SettingsError):
            Settings(**bad)


def test_new_lines_across_blocks(spark):
    f = spark.createDataFrame([("p", 1), ("p", 1500), ("p", 5000), ("q", 1)], "path string, line int")
    r = spark.createDataFrame([("p", 1000, 2100), ("p", 1400, 1600)], "path string, start_line int, end_line int")
    assert sorted((x.path, x.line, x.is_new) for x in findings.mark_new(f, r).collect()) == [("p", 1, False), ("p", 1500, True), ("p", 5000, False), ("q", 1, False)]


def test_rename_assignment_matches_one_by_one_choice(spark):
    import random

    random.seed(3)
    pool = list("abcdefghij")
    pick = lambda p, n: [(f"{p}{i:02d}", sorted(random.sample(pool, random.randint(5, 9)))) for i in range(n)]
    base, head = pick("b", 30) + [("b90", list("abcde"))] * 1, pick("h", 25)
    want, free = {}, {h for h, _ in head}
    sets = {k: set(v) for k, v in base + head}
    for b in sorted(b for b, _ in base):
        best = max(sorted(free), key=lambda h: len(sets[b] & sets[h]) / len(sets[b] | sets[h]), default=None)
        if best and len(sets[b] & sets[best]) / len(sets[b] | sets[best]) >= 0.7:
            want[b] = best
            free.discard(best)
    schema = "id string, hashes array<string>"
    got = snapshot.renames(spark.createDataFrame(base, schema), spark.createDataFrame(head, schema))
    assert {r.base_id: r.head_id for r in got.collect()} == want
