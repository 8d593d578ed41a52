"""Ranked search against scores of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import AWKWARD

from auditspark.llm import bloom_ranking as ranking

TERM = re.compile(ranking.TERM)
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ITEMS = "item_id long, text string, doc_id string, key int"


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _ranked(docs, items, k=50):
    bags = [(i, Counter(_terms(t))) for i, t, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in set(items):
        weights = {t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) for t in set(_terms(text)) if df[t]}
        scores = []
        for i, b in bags:
            m = 50 + (50 * b.total() * n_docs) // total
            score = sum(w * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t, w in weights.items() if t in b)
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item_id, r + 1, i if given else None, -s) for r, (s, given, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def _found(spark, docs, items, **options):
    df = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS).repartition(2)
    return sorted((tuple(r) for r in ranking.search(docs, df, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("k", [50, 3])
def test_best_documents(spark, docs, k, monkeypatch):
    monkeypatch.setattr(ranking, "ITEMS", 4)
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(400)] + ["the"] * 150 + ["Été", "日本", "it's", "A-B"]
    rows = [" ".join(rnd.choices(words, k=rnd.choice([3, 30, 200]))) for _ in range(400)]
    rows += [rows[7]] * 70 + ["w1 " * 500, "the " * 40, None, "...", ""]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 5, 40])))) for i in range(15)] + [(50, rows[7]), (51, "nowhere"), (52, "!"), (53, None), (54, "the THE the"), (54, "w3"), (54, "w3")]
    given = [(i, t) for i, t in enumerate(rows)]
    assert _found(spark, docs(*given), items, k=k) == _ranked(given, items, k)


def test_odd_rows(spark, docs, awkward, nothing):
    items = [(1, "one two three"), (None, "lorem MIT é日本 123"), (3, "no id here word"), (4, "x" * 30000)]
    assert _found(spark, awkward, items) == _ranked(AWKWARD, items)
    assert _found(spark, nothing, items) == [] and _found(spark, awkward, [(1, None)]) == []


def test_bounds_are_never_below_scores(spark, docs):
    rnd = random.Random(3)
    rows = [" ".join(rnd.choices([f"w{i}" for i in range(90)], weights=range(1, 91), k=rnd.randint(1, 400))) for _ in range(120)]
    groups = [r.asDict(recursive=True) for r in ranking.index(docs(*rows), 3).where("kind = 'd'").collect()]
    n_docs, n_terms = len(rows), sum(len(t.split()) for t in rows)
    names = [f"w{i}" for i in range(0, 90, 7)]
    hashes = ranking.term_hashes(names)[0].view(np.int64).tolist()
    items = [{"hashes": hashes, "weights": list(range(1, len(names) + 1))}, {"hashes": hashes[:1], "weights": [5]}]
    tight = []
    for g in groups:
        total = ranking.bounds(g, items, n_docs, n_terms)
        for j, i in enumerate(g["ids"]):
            bag = Counter(rows[i].split())
            m = ranking.length_factor(bag.total(), n_docs, n_terms)
            exact = [sum(w * ranking.saturation(bag[t], m) for t, w in zip(names, x["weights"]) if t in bag) for x in items]
            assert total[0, j] >= exact[0] and total[1, j] >= exact[1]
            tight.append((total[0, j] + 1) / (exact[0] + 1))
    assert len(tight) == 120 and np.median(tight) < 1.2
