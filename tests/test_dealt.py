"""Registries are built by many tasks though customers, narrow and well compressed, lie in one split."""

from pyspark.sql import functions as F

from auditspark.sources import derived


def test_agents_of_one_split_are_dealt_over_tasks(spark, tmp_path):
    spark.range(2000).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), (F.col("id") % 25).alias("c_nationkey"),
        F.lit(1.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    registry = derived.registry(spark, str(tmp_path))
    sizes = [r["n"] for r in registry.agents.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) < 500
    assert registry.declared.count() == 1500


def test_interval_lines_are_dealt_before_groups_are_built(spark, tmp_path):
    import datetime

    from auditspark.plans.queries import Q

    rows = [(1, 1, "N"), (1, 2, "A"), (1, 3, "N"), (1, 4, "A"), (2, 1, "R"), (2, 1, "N"), (3, 5, "N"), (None, 2, "A"), (4, None, "R")]
    spark.createDataFrame([(k, n, f, 1.0, datetime.datetime(1997, 1, 1)) for k, n, f in rows], "l_orderkey long, l_linenumber int, l_returnflag string, "
                          "l_quantity double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = Q["interval_new_findings"](spark, str(tmp_path))
    got = {(r["path"], r["line"], r["is_new"], r["n"]) for r in df.collect()}
    assert got == {("1", 1, False, 1), ("1", 2, True, 1), ("1", 3, True, 1), ("1", 4, True, 1), ("2", 1, True, 2), ("3", 5, False, 1),
                   (None, 2, False, 1), ("4", None, False, 1)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Relation [") == plan.count("RepartitionByExpression [path")
