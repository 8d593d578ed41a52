import hashlib

from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import text as X
from auditspark.functions.needles import needles
from auditspark.operators import line_rules, supply_chain
from auditspark.settings import Settings

H = hashlib.sha256(b"x").hexdigest()
TOKEN = "ghp" + "_" + H[:36]
KEY = "sk" + "-" + H[:30]


def rows(df):
    return [r.asDict() for r in df.orderBy("line", "column").collect()]


def test_secrets_every_match_with_column_and_no_raw_value(files):
    line = f"a = '{TOKEN}', '{KEY}'"
    got = rows(line_rules.scan(files(("src/a.py", f"x = 1\n{line}\n"))))
    assert [(r["rule_id"], r["line"], r["column"], r["confidence"]) for r in got] == [
        ("SEC001", 2, line.index(TOKEN) + 1, "high"), ("SEC001", 2, line.index(KEY) + 1, "high")]
    assert TOKEN not in str(got) and KEY not in str(got)
    assert f"{TOKEN[:6]}…[REDACTED:{hashlib.sha256(TOKEN.encode()).hexdigest()[:12]}]" in got[0]["snippet"]
    # equal contexts of one file are told apart by their number
    assert got[0]["fingerprint"] != got[1]["fingerprint"]
    shown = got[0]["snippet"]
    assert got[0]["fingerprint"] == hashlib.sha256(f"SEC001:src/a.py:{shown}".encode()).hexdigest()[:16]


def test_secret_confidence_ladder(files):
    flat = "sk-" + "a" * 24
    got = rows(line_rules.scan(files(
        ("src/a.py", f"# {TOKEN}\n{flat}\nexample {TOKEN}\n"), )))
    assert [r["confidence"] for r in got] == ["low", "low", "low"]
    got = rows(line_rules.scan(files(("tests/a.py", f"k = '{TOKEN}'"))))
    assert [r["confidence"] for r in got] == ["medium"]


def test_passwords(files):
    text = "\n".join([
        "password = 'hunter2secret9'", "password = os.environ['X']", "pwd = 'password'", "passwd: '${VAULTED}'", "db_password = 'abababab'",
        "# admin_password = 'Zq81kLmN'"])
    got = rows(line_rules.scan(files(("src/a.py", text))))
    assert [(r["line"], r["confidence"], r["severity"]) for r in got] == [(1, "high", "critical"), (5, "low", "high"), (6, "low", "high")]
    assert "hunter2secret9" not in str(got)
    kept = rows(line_rules.scan(files(("src/a.py", text)), Settings(severity_overrides={"SEC002": "low"})))
    assert {r["severity"] for r in kept} == {"low"}


def test_sql_http_timeout_and_comments(files):
    text = "\n".join([
        'q = f"SELECT a FROM t WHERE x = {x}"', 'q = "SELECT a FROM t WHERE x = ?"', '# q = f"SELECT a FROM t WHERE x = {x}"',
        "u = 'http://localhost/x', 'http://api.acme.com/y'", "r = requests.get(u)", *["y = 1"] * 9, "r = requests.get(", "  u,", "  timeout=3)"])
    got = [(r["rule_id"], r["line"]) for r in rows(line_rules.scan(files(("src/a.py", text))))]
    assert got == [("SEC003", 1), ("NET001", 4), ("NET002", 5)]


def test_swallowed(files):
    py = "try:\n  go()\nexcept ValueError:\n  pass\n"
    py = "try:\n    go()\nexcept ValueError:\n    pass\ntry:\n    go()\nexcept E:\n    raise\n"
    got = rows(line_rules.scan(files(("src/a.py", py), ("src/b.ts", "try { go() } catch (e) { }\n"), ("tests/c.py", py))))
    assert [(r["path"], r["rule_id"], r["line"]) for r in sorted(got, key=lambda r: r["path"])] == [("src/a.py", "REL001", 3), ("src/b.ts", "REL001", 1)]


def test_disabled_rule(files):
    got = rows(line_rules.scan(files(("src/a.py", f"k = '{TOKEN}'\nr = requests.get(u)")), Settings(enabled={"SEC001": False})))
    assert [r["rule_id"] for r in got] == ["NET002"]


def test_supply_chain_variants(files):
    text = "\n".join([
        "m = A.from_pretrained('org/x')", "m = A.from_pretrained('org/x', revision='1')", "m = A.from_pretrained('./x')",
        "m = A.from_pretrained('org/y', trust_remote_code=True)", "c = dict(model='gpt-4o')", "d = dict(model='gpt-4o')",
        "e = dict(model='gpt-4o-2024-08-06')", "k = C(base_url='http://llm.corp.net/v1')", "k = C(base_url='http://localhost/v1')", "w = torch.load(p)"])
    got = [(r["variant"], r["line"]) for r in rows(supply_chain.detect(files(("src/a.py", text))))]
    assert got == [("unpinned-artifact", 1), ("trust-remote-code", 4), ("floating-alias", 5), ("insecure-endpoint", 8)]


def test_entropy_and_redaction(spark):
    df = spark.createDataFrame([("abab",), ("",), ("aaaa",)], "t string")
    assert [r[0] for r in df.select(X.entropy(F.col("t"))).collect()] == [1.0, 0.0, 0.0]


def test_literal_shortcut_never_hides_a_match(spark):
    """For every pattern: texts that match still match with the shortcut, also beyond ASCII."""
    texts = [
        "import openai\nfrom langchain.agents import AgentExecutor\nAgentExecutor(tools=[x])", "STRIPE_SECRET_KEY stripe.Refund.create()",
        "SELECT a FROM b; insert into t; 'x' \u212aafka CELERY", "É http://x.zendesk.com ſmtplib SMTPLIB", "subprocess.run(x); os.system(y); eval(z)",
        "authenticated limiter approved temperature=0.1 logger.info( structlog", "plain prose without anything", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for table in (fv.FRAMEWORK_PATTERNS, fv.PROVIDER_PATTERNS, fv.CAPABILITY_PATTERNS, fv.INTEGRATION_PATTERNS, fv.CONTROL_PATTERNS, fv.PERMISSION_PATTERNS):
        quick = X.with_text(df, "m", lambda d: F.struct(*[X.matches(d, p).alias(n) for n, p in table.items()]), content="t")
        plain = df.select("t", *[F.col("t").rlike(X.jre(p)).alias(n) for n, p in table.items()])
        assert sorted(map(str, (tuple(r["m"]) for r in quick.collect()))) == sorted(map(str, (tuple(r)[1:] for r in plain.collect())))
    assert needles(r"(?i)\bredis\b|kafka") == ("kafka", "redis")
    assert needles(r"\w+") is None
    words = ("open", "openai", "pen", "ai x", "a.b")
    assert X.any_of(words) == r"(?:a(?:\.b|i\ x)|open(?:ai)?|pen)"
    doc = X.Doc(F.col("t"), F.col("_ascii"), F.col("_hits"))
    found = spark.createDataFrame([("use OpenAI x",), ("a.b axb",), ("é",)], "t string").select(*X.Doc.columns(doc.text, words)).collect()
    assert [(r._ascii, sorted(r._hits)) for r in found] == [(True, ["ai x", "openai", "pen"]), (True, ["a.b"]), (False, [])]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_read_once_and_values_computed_once(files):
    df = files(("src/a.py", "password = 'Tr0ub4dor99'"))
    plan = _plan(line_rules.scan(df))
    assert plan.count("Generate explode") == 1 and "Union" not in plan
    assert plan.count("database_password") <= 4  # the value is not extracted for each of its characters
    assert _plan(supply_chain.detect(df)).count("aggregate(") == 5  # places of each of five patterns, once


def test_candidate_lines_of_any_case_and_beyond_ascii(files):
    text = "PASSWORD = 'Tr0ub4dor99'\npaſſword = 'Tr0ub4dor99'\nRequests.get(u)\ny = 1\nx = 'HTTP://a.com'\nq = f'dElEtE from {t}'\nq = f'inſert into {t}'"
    got = [(r["line"], r["rule_id"]) for r in rows(line_rules.scan(files(("src/a.py", text))))]
    assert sorted(got) == [(1, "SEC002"), (2, "SEC002"), (6, "SEC003"), (7, "SEC003")]


def test_match_places_over_several_lines(files):
    df = files(("a.py", "é ab\n\nab x ab\nzz"), ("b.py", "a\nb a\nb"), ("c.py", "none"))
    got = {r["path"]: [tuple(m) for m in r["m"]] for r in df.select("path", X.match_rows(df.content, r"a\s?b").alias("m")).collect()}
    assert got == {"a.py": [(1, 3, 2, "ab"), (3, 1, 6, "ab"), (3, 6, 11, "ab")], "b.py": [(1, 1, 0, "a\nb"), (2, 3, 4, "a\nb")], "c.py": []}
