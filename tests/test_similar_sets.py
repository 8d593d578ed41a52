"""Similar evidence sets meet by number and size."""

import itertools
import random

from pyspark.sql import functions as F

from auditspark.operators import snapshot


def _brute(base, head, t):
    out = set()
    for b, h in itertools.product({frozenset(s) for s in base if s}, {frozenset(s) for s in head if s}):
        j = len(b & h) / len(b | h)
        if j >= t:
            out.add(("|".join(sorted(b)), "|".join(sorted(h)), j))
    return out


def test_similar_signatures_of_dense_sets_and_all_sizes(spark):
    """Sets that share most of a small vocabulary, from one hash to forty, against every pair."""
    r = random.Random(5)
    words = [f"w{i:02}" for i in range(40)]
    make = lambda: [r.sample(words, r.choice([1, 2, 3, 5, 9, 20, 27, 28, 29, 38, 39, 40])) for _ in range(60)] + [[], ["w01"]]
    base, head = make(), make()
    frame = lambda sets, side: spark.createDataFrame([(f"{side}{i}", s) for i, s in enumerate(sets)], "id string, hashes array<string>")
    for t in (0.5, 0.7, 1.0):
        got = snapshot.similar_signatures(frame(base, "b"), frame(head, "h"), t).collect()
        assert {tuple(x) for x in got} == _brute(base, head, t) and len(got) == len(set(got))


def test_sets_meet_by_number_and_class_of_size(spark):
    one = spark.createDataFrame([("a", ["x", "y"])], "id string, hashes array<string>")
    plan = snapshot.similar_signatures(one, one.select(F.lit("b").alias("id"), "hashes"))._jdf.queryExecution().sparkPlan().toString()
    keys = [line for line in plan.split("\n") if "Join [" in line]
    assert any("[t#" in k and "like#" in k for k in keys), keys
    assert not any("token#" in k for k in keys)
