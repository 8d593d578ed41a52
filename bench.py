"""Runs the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1); BENCH_CPUS: local cores (default 8).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditspark.plans.queries import Q  # noqa: E402
from auditspark.session import local_session  # noqa: E402

HEADLINE = [
    "span_summary", "span_value_counts", "first_unapproved_ref", "drift_frequency_shift", "drift_summary", "rt_contradictions",
    "runtime_dimensions", "dimension_scores", "exposure_rank_topk", "graph_edges", "graph_overlay", "decl_contradictions", "assurance_long",
    "snapshot_diff_items", "snapshot_diff_approved", "interval_new_findings", "attribution", "diff_hunks", "doc_rule_scan", "doc_redacted",
    "insecure_urls", "code_line_findings", "code_features", "code_candidates", "stream_daily_totals", "stream_sessions",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
