"""Joins are decided by measured sizes."""

import __spark_entry__ as entry


def _customers(spark, tmp_path, n=40):
    rows = [(i, f"Customer#{i}", i % 25, float(i * 10 - 50), ["AUTOMOBILE", "BUILDING", "FURNITURE"][i % 3]) for i in range(1, n)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
        str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_estimates_broadcast_nothing(spark, tmp_path):
    d = _customers(spark, tmp_path)
    queries = entry.queries()
    for name in ("graph_edges", "graph_nodes", "graph_edge_findings", "snapshot_diff_dimensions"):
        plan = queries[name](spark, d)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name


def test_limit_of_broadcasts_stays_the_sessions_own(spark):
    names = (entry.STATIC, entry.MEASURED)
    before = [spark.conf.get(n, None) for n in names]
    try:
        spark.conf.set(entry.STATIC, "5000000")
        spark.conf.unset(entry.MEASURED)
        entry._broadcast_by(spark, True)
        entry._broadcast_by(spark, True)
        assert [spark.conf.get(n) for n in names] == ["-1", "5000000"]
        entry._broadcast_by(spark, False)
        assert [spark.conf.get(n, None) for n in names] == ["5000000", None]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_texts_of_single_files_use_all_cores(spark, tmp_path):
    from auditspark.sources import derived

    for name, columns in (("documents", "doc_id long, text string"), ("pages", "page_id long, html string"),
                          ("conversations", "conv_id long, turn long, text string")):
        row = (1, 2, "x") if name == "conversations" else (1, "x")
        spark.createDataFrame([row, (*row[:-1], None)], columns).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = derived.texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert sorted((r.path, r.content) for r in texts.collect()) == sorted(
        (p, c) for p in ("documents/1.py", "pages/1.py", "conversations/1-2.py") for c in ("x", ""))
