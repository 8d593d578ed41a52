"""Facts of a file: the same texts and names as the standard library gives, with each file's lines cut once."""

import ast

from pyspark.sql import functions as F

from auditspark.operators import flow
from auditspark.sources import code_corpus

SOURCES = [
    "x = f(\r\n  a,\r\n b)\r\ny.z = x\r\nfor i in 'é' + q(x):\r\n    w = 'é' + g(1)\n",
    "x = f(a)\ry = g(x)\r",
    "x = f(a)\n\x0c\ny = g('é', x); z = h(1).i[2](x)\nasync def a(x, y=1, *b, **c):\n    t: int = await u(x)\n    t += k\n",
    "a = b = c.d(e, *f, g=h(lambda i: i, [j for j in k if l]))\nwhile m:\n    n[0].o = {p: q, 'r': f'{s}'}\n",
]


def test_texts_and_names_are_those_of_the_standard_library():
    for content in SOURCES:
        calls = [n for n in ast.walk(ast.parse(content)) if isinstance(n, ast.Call)]
        want = sorted((ast.unparse(c.func), ast.get_source_segment(content, c), sorted({n.id for n in ast.walk(c) if isinstance(n, ast.Name)}))
                      for c in calls)
        got = sorted((r[3], r[7], r[9]) for r in flow.file_facts("a.py", content) if r[1] == "call")
        assert got == want and want


def test_lines_are_cut_once_a_file(monkeypatch):
    monkeypatch.setattr(ast, "get_source_segment", lambda *a, **k: 1 / 0)
    rows = flow.file_facts("a.py", "def f(c):\n    for i in c:\n        t = g(i).h\n        u.v = t\n")
    assert [(r[1], r[4] > 0, r[5], r[7]) for r in rows] == [
        ("function", True, 1, ""), ("loop", True, 2, "for i in c:\n        t = g(i).h\n        u.v = t"), ("assign", True, 3, "g(i).h"),
        ("call", True, 3, "g(i)"), ("store", True, 4, "u.v = t")]
    assert [r[4] for r in rows] == sorted({r[4] for r in rows})


def test_facts_read_once_are_not_stored(files):
    facts = flow.facts(files(("a.py", "x = f(a)\n"), ("b.py", "def f(:\n")), stored=False)
    assert sorted((r.path, r.kind, r.text) for r in facts.collect()) == [("a.py", "assign", "f(a)"), ("a.py", "call", "f(a)"), ("b.py", "degraded", None)]
    assert "MapInArrow" in facts._jdf.queryExecution().executedPlan().toString()


def test_files_are_dealt_evenly_though_one_split_has_all_rows(spark, tmp_path):
    """One row group in a file of many splits: all its rows are one split's."""
    spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.sha2(F.col("id").cast("string"), 512).alias("pad")).coalesce(
        1).write.parquet(f"{tmp_path}/orders.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "16k")
        raw = code_corpus.raw_files(spark, str(tmp_path))
        sizes = [r["n"] for r in raw.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 1000
