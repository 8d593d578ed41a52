"""Shards, mixing, licences, BPE and edit-aware counts against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import AWKWARD, rows_of
from pyspark.sql import functions as F

from auditspark.llm import bpe_segment_tree as bpe
from auditspark.llm import edit_token_counts as edits
from auditspark.llm import feistel_sharding as shards
from auditspark.llm import licence_index as licences
from auditspark.llm import source_mix as mixing
from auditspark.llm.common import text_or_empty, tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_balanced_gapless_and_reproducible(spark, docs, awkward, nothing):
    made = docs(*[f"text {i % 40}" for i in range(1000)])
    got = shards.shard(made).collect()
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    assert sorted(r.row for r in got) == list(range(1000))
    again = shards.shard(made.repartition(7, "text"))
    assert rows_of(again, "doc_id", "shard", "slot") == sorted(((r.doc_id, r.shard, r.slot) for r in got), key=repr)
    odd = shards.shard(awkward).collect()
    assert len(odd) == len(AWKWARD)
    expected = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in AWKWARD), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in odd), key=repr) == expected
    assert shards.shard(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = spark.range(n).select(shards.permuted(F.col("id"), n, 3).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_its_targets(docs, awkward, nothing):
    rnd = random.Random(4)
    many = [(i, "w " * rnd.randint(0, 90), rnd.choice(["s1", "s2", "s2", "s2", "s2", "t", None])) for i in range(400)]
    for rows, df in ((many, docs(*many)), (AWKWARD, awkward)):
        got = mixing.mix(df).collect()
        sizes = Counter()
        for _, text, source in rows:
            sizes[source] += len(WORDS.findall(text or ""))
        want = _targets(sizes)
        assert len(got) == len(rows)
        for source in sizes:
            own = [r for r in got if r.source == source]
            assert own[0].target == pytest.approx(want[source])
            assert sum(r.taken for r in own) == round(own[0].target) or abs(sum(r.taken for r in own) - own[0].target) <= 0.5
            assert all(0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[source] for r in own)
            epochs = int(own[0].target // max(1, sizes[source]))
            border = [r for r in sorted(own, key=lambda r: r.key) if r["size"]]
            extra = [r.taken - epochs * r["size"] for r in border]
            assert all(x >= 0 for x in extra)
            full = [x == r["size"] for x, r in zip(extra, border)]
            assert full == sorted(full, reverse=True) and sum(0 < x < r["size"] for x, r in zip(extra, border)) <= 1
    assert rows_of(mixing.mix(awkward), "doc_id", "taken") == rows_of(mixing.mix(awkward.repartition(5)), "doc_id", "taken")
    assert mixing.mix(nothing).count() == 0
    repeated = mixing.mixed(awkward)
    assert repeated.columns == awkward.columns and repeated.where("text is null or text = ''").count() == 0


def _licence_places(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), found


def test_licence_scan(docs, awkward, nothing):
    notice = " ".join(licences.TEMPLATES["bsd"][0].split())
    texts = ["Released under the MIT License.", "mit-license MIT\nLICENSE", "general general public license public license", notice.title(),
             "redistribution of binary forms", licences.TEMPLATES["mit"][0] + " apache license", "", None, "mit éxlicense", "permission hereby granted", "nothing"]
    for rows, df in (([(i, t) for i, t in enumerate(texts)], docs(*texts)), (AWKWARD, awkward)):
        got = sorted((r.asDict() for r in licences.scan(df).collect()), key=lambda r: (str(r["doc_id"]), r["n_words"]))
        want = sorted(((i, *_licence_places(t)) for i, t, *_ in rows), key=lambda r: (str(r[0]), r[1]))
        for g, (i, n, places) in zip(got, want, strict=True):
            at = [p for p, _ in places]
            assert (g["doc_id"], g["n_words"], g["n_base"]) == (i, n, len(at))
            assert (g["first_word"], g["last_word"]) == ((min(at), max(at)) if at else (None, None))
            assert g["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    by = {r.doc_id: r.labels for r in licences.scan(docs(*texts)).collect()}
    assert by[3] == "bsd" and by[4] == "" and by[5] == "apache,mit" and by[9] == "" and by[10] == ""
    assert licences.scan(nothing).count() == 0


def _licence_labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    labels, best = {label for _, label in _licence_places(text)[1]}, 0.0
    score = 1.0 if labels else 0.0
    for label, (notice, key) in licences.TEMPLATES.items():
        own, k = notice.split(), key.split()
        content = [i for i, w in enumerate(own) if w not in licences.COMMON]
        offset = next(i for i in range(len(own)) if own[i:i + len(k)] == k)
        for start in range(-len(own), len(words)):
            votes = sum(0 <= start + i < len(words) and words[start + i] == own[i] for i in content)
            if votes >= 2 and votes / len(content) >= licences.LEAST_SHARE and start + offset >= 0 and words[start + offset:start + offset + len(k)] == k:
                labels.add(label)
                best = max(best, votes / len(content))
    return ",".join(sorted(labels)), score or best


def test_many_notices_in_one_file(docs):
    rnd, notices = random.Random(8), {t: notice for t, (notice, _) in licences.TEMPLATES.items()}
    vocabulary = sorted(licences.postings())
    texts = [" ".join(notices.values()), *[" ".join(notices[t] for t in ts.split()) for ts in ("bsd isc lgpl", "bsd cc lgpl mit")]]
    texts += [" ".join([*rnd.sample(vocabulary, len(vocabulary)), notice, *rnd.choices(vocabulary, k=400)]) for notice in notices.values()]
    for _ in range(60):
        words = " ".join(rnd.sample(list(notices.values()), rnd.randint(1, 9))).split()
        for at in rnd.sample(range(len(words)), len(words) * rnd.choice([0, 1, 2, 3]) // 10):
            words[at] = rnd.choice([*vocabulary, "other"])
        texts.append(" ".join(words))
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(docs(*texts)).collect()}
    assert got[0][0] == "apache,bsd,cc,gpl,isc,lgpl,mit,mpl,unlicense"
    assert got == {i: _licence_labels(t) for i, t in enumerate(texts)}


def test_bpe_equals_the_library(docs, awkward, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, own, rnd = Tokenizer.from_file(path), bpe.ByteBpe(path), random.Random(1)
    letters = [*"ab 'st\n\t  .,!19é日  <|", "<|endoftext|>", "'re", "  ", "\x1c", "\x85", " "]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 14))) for _ in range(3000)] + ["abcde" * 3000, "!" * 500]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
    want = []
    for i, text, _ in AWKWARD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe.encoded(awkward), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encoded(nothing, with_ids=True).count() == 0



def test_bpe_trees_of_every_size_equal_the_library_and_the_single_tree(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, own, rnd = Tokenizer.from_file(path), bpe.ByteBpe(path), random.Random(4)
    monkeypatch.setattr(bpe, "CACHE", 300)  # tables change over many times
    monkeypatch.setattr(bpe, "TOGETHER", 2_000)
    texts = ["a" * n for n in range(200)] + ["é" * n for n in range(25, 40)] + ["<|endoftext|>x<|endoftext|><|endoftext|>"]
    texts += ["".join(rnd.choice("abcdeginrst") for _ in range(n)) for n in range(1, 140) for _ in range(5)]
    texts += [" ".join(rnd.choices(texts, k=3)) for _ in range(200)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    words = [t.encode() for t in texts if 0 < len(t.encode()) <= 64]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge_side_by_side(words, 64)] == [own.merge(w) for w in words]


def test_edited_counts_equal_a_new_count(awkward, nothing):
    from tokenizers import Tokenizer

    count, rnd = edits.Counter(tokenizer_path("byte_bpe_50k.tiktoken")), random.Random(2)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    letters = [*"ab 'st\n\t  .,!19éd日re  ", "'re", " '", "ll", "  "]
    total = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    for _ in range(800):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 30)))
        tree = edits.SegmentTree(*count.leaves(text))
        for _ in range(4):
            p, d, new = rnd.randint(-1, len(text) + 2), rnd.choice([0, 0, 1, 2, 5, 40]), "".join(rnd.choices(letters, k=rnd.choice([0, 1, 2, 8])))
            text, _ = tree.edit(text, p, d, new, count)
            assert tree.tokens == total(text) and tree.length == len(text)
            assert [x.tolist() for x in tree.leaves()] == [x.tolist() for x in count.leaves(text)]
    made = edits.recounted(edits.trees(awkward), edits.own_edits(text_or_empty())).collect()
    assert len(made) == len(AWKWARD)
    for r in made:
        assert r.n_tokens_edited == total(r.edited) and r.n_chars_edited == len(r.edited)
    long = next(r for r in made if r.doc_id == 7)
    assert long.encoded_pretokens < 60 < long.n_pretokens
    none = edits.recounted(edits.trees(awkward), F.lit(None)).collect()
    assert all(r.n_edits == 0 and r.n_tokens == r.n_tokens_edited for r in none)
    assert edits.trees(nothing).count() == 0
