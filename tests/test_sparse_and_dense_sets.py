"""Evidence sets that share common hashes are compared block by block, and renames look up no more heads than they need."""

import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import alike, snapshot

SCHEMA = "id string, hashes array<string>"


def _likeness(a, b):
    return len({*a} & {*b}) / len({*a} | {*b})


def _one_by_one(base, head, t=0.7):
    want, free = {}, dict(head)
    for b, s in sorted(base):
        best = min(free, key=lambda h: (-_likeness(s, free[h]), h), default=None)
        if best and _likeness(s, free[best]) >= t:
            want[b] = (best, _likeness(s, free.pop(best)))
    return want


def _dense(r, side, n, words, copies=1):
    """Sets that hold most of a small vocabulary, some of them several times."""
    rows = [r.sample(words, r.randint(len(words) * 3 // 5, len(words) * 4 // 5)) for _ in range(n)]
    return [(f"{side}{i:03}-{c}", s) for i, s in enumerate(rows) for c in range(copies if i % 3 else 1)]


@pytest.mark.parametrize("meet", [0, 1 << 60])
def test_rare_and_common_hashes_give_the_same_pairs(spark, monkeypatch, meet):
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    base, head = _dense(r, "b", 70, words), _dense(r, "h", 70, words)
    monkeypatch.setattr(alike, "MEET", meet)
    monkeypatch.setattr(alike, "BLOCK", 16)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    got = {(x.base_id, x.head_id, x.jaccard) for x in snapshot.best_candidates(frame(base), frame(head), 0.6).collect()}
    want = set()
    for b, s in base:
        j, h = min((-_likeness(s, o), h) for h, o in head)
        if -j >= 0.6:
            want.add((b, h, -j))
    assert got == want and len(want) > 20


@pytest.mark.parametrize("spare", [0, 3])
def test_short_lists_are_looked_up_again(spark, monkeypatch, spare):
    r = random.Random(8)
    words = [f"w{i}" for i in range(20)]
    base, head = _dense(r, "b", 40, words, 4), _dense(r, "h", 30, words, 3)
    monkeypatch.setattr(snapshot, "SPARE", spare)
    got = snapshot.renames(spark.createDataFrame(base, SCHEMA), spark.createDataFrame(head, SCHEMA)).collect()
    assert {x.base_id: (x.head_id, x.jaccard) for x in got} == _one_by_one(base, head)


def test_pairs_of_common_hashes_are_neither_shuffled_nor_joined(spark):
    """400 sets a side that share 40 hashes: 160,000 pairs met over and over in a join, each with both of its sets."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    make = lambda side: spark.createDataFrame(_dense(r, side, 400, words), SCHEMA)
    close = alike.alike(alike.numbered(make("b"), make("h")).ordered, 0.7)
    assert close.few.isEmpty()
    plan = close.pairs()._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan
    assert close.crowd.where(F.col("side") == "b").count() == 400


def test_agents_without_an_id_get_renames_too(spark):
    sets = [(None, ["a", "b", "c"]), ("b2", ["a", "b", "c"])]
    got = snapshot.renames(spark.createDataFrame(sets, SCHEMA), spark.createDataFrame([("h1", ["a", "b", "c"]), ("h2", ["a", "b", "c"])], SCHEMA))
    assert {tuple(x) for x in got.collect()} == {(None, "h1", 1.0), ("b2", "h2", 1.0)}
