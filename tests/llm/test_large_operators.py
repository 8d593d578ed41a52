"""Near duplicates, fingerprints, id files, search, grades and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import AWKWARD, rows_of

from auditspark.llm import hyperminhash as near
from auditspark.llm import id_range_coder as coder
from auditspark.llm import ordinal_quality as grades
from auditspark.llm import pivot_topk as search
from auditspark.llm import weighted_fingerprints as prints
from auditspark.llm.common import tokenizer_path
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _components(rows, k):
    sets = {}
    for i, text, *_ in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_duplicates(docs, awkward, nothing):
    rnd, words = random.Random(3), [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = rnd.choices(words, k=rnd.choice([6, 12, 60, 150]))
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), rnd.choice([" ", "\n", "\t "]).join(copy).upper()))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, " ", "one", "ONE", "one two"])]
    assert rows_of(near.near_duplicates(docs(*rows), words=2), "doc_id", "n_shingles", "component_id", "kept") == sorted(_components(rows, 2), key=repr)
    got = near.near_duplicates(awkward).collect()
    by = Counter((r.doc_id, r.component_id, r.kept) for r in got)
    assert len(got) == len(AWKWARD) and by[4, 1, False] == 2 and by[1, 1, True] == 1 and by[None, None, True] == 2 and by[2, 2, True] == 1
    kept = near.deduplicated(awkward)
    assert kept.columns == awkward.columns and rows_of(kept, "doc_id") == sorted([(1,), (2,), (3,), (5,), (6,), (7,), (8,), (9,), (10,), (None,), (None,)], key=repr)
    assert near.near_duplicates(nothing).count() == 0


def test_any_64_bit_id_is_kept(docs, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2**62 + 5, text), (2**62 + 9, text), (2**63 - 1, text + " more"), (-2**63, "other words"), (None, text), (2**63 - 2, "alone here")]
    for dense in (near.DENSE, 1):  # the second compares blocks pair by pair
        monkeypatch.setattr(near, "DENSE", dense)
        got = rows_of(near.near_duplicates(docs(*rows), words=2), "doc_id", "component_id", "kept")
        first = 2**62 + 5
        assert got == sorted([(first, first, True), (2**62 + 9, first, False), (2**63 - 1, first, False), (None, first, False), (-2**63, -2**63, True), (2**63 - 2, 2**63 - 2, True)], key=repr)
    assert rows_of(near.deduplicated(docs(*rows), words=2), "doc_id") == sorted([(first,), (-2**63,), (2**63 - 2,)], key=repr)


def test_a_small_difference_is_found_in_blocks():
    import pandas as pd

    shingle = near.Shingler(2)
    texts = [" ".join(f"x{i}" for i in range(40)), " ".join(f"x{i}" for i in range(41)), " ".join(f"y{i}" for i in range(40))]
    sets = [shingle(t) for t in texts]
    frame = lambda side: pd.DataFrame({f"{side}_{k}": v for k, v in {"rep": 0, "id": [0, 1, 2], "component": [0, 1, 2], "registers": [near.registers(s).tobytes() for s in sets],
                                                                  "shingles": [s.tobytes() for s in sets]}.items()})
    assert near._compare_blocks(frame("l"), frame("r"), 80).values.tolist() == [[0, 1], [1, 0]]


def test_estimate_follows_similarity():
    shingle, rnd = near.Shingler(1), random.Random(5)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(30):
            n = 400
            both = round(n * 2 * share / (1 + share))
            pool = [str(rnd.random()) for _ in range(2 * n - both)]
            a, b = (near.registers(shingle(" ".join(x))) for x in (pool[:n], pool[n - both:]))
            errors.append(near.estimate((a == b).mean()) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03


def test_fingerprints(docs, awkward, nothing):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(60)], k=rnd.randint(0, 200))) for _ in range(60)]
    texts += texts[:5]
    got = {r.doc_id: r for r in prints.fingerprints(docs(*texts)).collect()}
    errors = []
    for i in range(len(texts) - 1, -1, -1):
        a, b = texts[i], texts[(i - 1) % len(texts)]
        half = len(a) // 2
        edited, r = a[:len(a) - half] + b[:half], got[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near_ in ((edited, r.near_edited), (b, r.near_next)):
            x, y = Counter(a.split()), Counter(other.split())
            errors.append(near_ - (sum((x & y).values()) / sum((x | y).values()) if x or y else 1))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    assert all(got[i].fingerprint == got[60 + i].fingerprint for i in range(5))
    odd = prints.fingerprints(awkward).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in odd)
    assert prints.fingerprints(docs("only one text")).first().near_next == 1
    assert prints.fingerprints(nothing).count() == 0


def test_likeness_has_the_error_of_64_samples(docs):
    rnd, texts = random.Random(9), []
    for _ in range(150):
        base = rnd.choices([f"w{i}" for i in range(500)], k=80)
        texts += [" ".join(base), " ".join(w if rnd.random() < 0.85 else rnd.choice(base) + "x" for w in base)]
    got = {r.doc_id: r.near_next for r in prints.fingerprints(docs(*texts)).collect()}
    ratios = []
    for i in range(1, len(texts), 2):
        x, y = Counter(texts[i].split()), Counter(texts[i - 1].split())
        like = sum((x & y).values()) / sum((x | y).values())
        ratios.append((got[i] - like) ** 2 / (like * (1 - like)))
    assert np.mean(ratios) < 1.5 / 64


def test_blocks_round_trip_and_tell_damage():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, k).astype(np.uint16) for k in (0, 1, 2, 5, 300, 2048)] + [
        np.zeros(2048, np.uint16), np.tile(rng.integers(0, 50000, 7), 300)[:2048].astype(np.uint16), np.full(50, 65535, np.uint16),
        (rng.integers(0, 3, 2048) * 30000).astype(np.uint16)]
    coded = coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(coded)))
    assert len(coded[6]) < 100 and len(coded[7]) < 300
    bad = bytearray(coded[5])
    bad[40] ^= 8
    with pytest.raises(ValueError):
        coder.decode([bytes(bad)])
    a, b = b"abc" * 100, b"defg" * 33
    assert coder.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_id_files(awkward, nothing):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0, []
    rows = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, _ in AWKWARD]
    for i, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes())):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows_of(coder.round_trip(awkward), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert coder.round_trip(nothing).count() == 0


def test_search_is_exact(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(700, 9)), 2)
    v[100:300] = v[5]  # ties
    rows = [(int(i), [float(x) for x in v[i]], 1) for i in range(700)]
    odd = [(None, rows[0][1], 0), (900, None, 0), (1000, [1.0, None], 0), (1100, [float("nan")] * 9, 0), (1200, [float("inf")] * 9, 0), (800, [], 0), (801, [1.0], 0), (801, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cell int")
    known = {i: np.floor(1024 * np.array(list(x) + [0.0] * (9 - len(x)))).astype(np.int64) for i, x, _ in [*rows, odd[5], odd[6]]}
    ids, table = np.array(sorted(known)), np.array([known[i] for i in sorted(known)])
    want = []
    for i in ids[ids % 100 == 0]:
        score = table @ known[i]
        other = ids != i
        for k, x in enumerate(np.lexsort((ids[other], -score[other]))[:10]):
            want.append((int(i), k + 1, int(ids[other][x]), int(score[other][x])))
    assert rows_of(search.search(df, F.col("vec_id") % 100 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    few = search.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0)
    assert few.count() == 2
    assert search.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_grades_separate_and_order(spark, docs, awkward, nothing):
    rnd, common = random.Random(7), [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        words, quality, toxic = rnd.choices(common, k=60), int(rnd.random() < 0.8), int(rnd.random() < 0.2)
        if not quality:
            words = [w.upper() + "%%%" for w in words]
        if toxic:
            words[rnd.randrange(60)] = "vile"
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, quality, toxic))
    made = docs(*rows)
    rated = spark.createDataFrame([*labels, (None, 1, 0), (0, None, 0), (3, 5, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in grades.graded(made, rated).collect()}
    right = [got[i].keep == ("%%%" not in t and "vile" not in t) for i, t in rows if i % 3 == 0]
    assert np.mean(right) > 0.97 and all(0 <= r.expected_grade <= 2 and r.tail_probability <= 1 for r in got.values())
    both, one = (np.mean([got[i].expected_grade for i, t in rows if ("%%%" in t) + ("vile" in t) == faults]) for faults in (2, 1))
    assert both < one
    odd = grades.graded(awkward, rated).collect()
    assert len(odd) == len(AWKWARD) and not any(r.keep for r in odd if r.doc_id in (2, 3, 5))
    assert grades.selected(made, rated).count() == sum(r.keep for r in got.values()) and grades.selected(awkward, rated).columns == awkward.columns
    unrated = grades.graded(awkward, rated.limit(0))
    assert unrated.where("keep").count() == 9 and grades.graded(nothing, rated).count() == 0


def test_pipeline_stages_hold(spark, tmp_path):
    import corpus_pipeline as pipeline
    from auditspark.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for number, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = [r.doc_id for r in docs.collect()]
        assert set(got) <= set(before)
        if number < 3:
            assert docs.columns == columns and all(r.text == before[r.doc_id] for r in docs.collect())
        if name == "near_dedup":
            want = [c for c in _components(sorted(before.items()), 5) if c[3]]
            assert sorted(got) == [c[0] for c in want]
        if name == "quality":
            assert len(got) > 0.6 * len(before)
    assert defaultdict(int, Counter(name for name, _ in pipeline.STAGES))["near_dedup"] == 1 and 0 < len(got) <= 3 * len(before)
