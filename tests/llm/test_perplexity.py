"""Quality counts and the Kneser-Ney model against plain versions of both."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_fixtures import AWKWARD

from auditspark.llm import perplexity_rules as rules
from auditspark.llm import text_arrays as ta

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def _prose(rnd, letters, n):
    syllables = ["".join(rnd.choices(letters, k=2)) for _ in range(12)]
    return lambda: " ".join("".join(rnd.choices(syllables, weights=range(1, 13), k=rnd.randint(1, 3))) for _ in range(rnd.randint(n, 3 * n))) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    en, fr = _prose(rnd, "abcdeä", 40), _prose(rnd, "qrstué日", 40)
    rows = [(i, en(), "en") for i in range(80)] + [(100 + i, fr(), "fr") for i in range(60)]
    rows += [(200, "ZX!! 9Q?? " * 40 + "".join(rnd.choices("ZXQ!?98", k=300)), "en"), (201, fr() + fr(), "en"), (202, "word", "xx"), (203, rows[0][1], "en"), (203, rows[0][1], "en"), (204, None, None)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, fold string").repartition(4)


def _tables(texts):
    """Plain modified Kneser-Ney: (counts by order, discounts by order)."""
    raw = Counter()
    for t in texts:
        full = "\n" * 4 + t
        raw.update(full[i:i + 5] for i in range(len(full) - 4))
    level = {5: raw}
    for k in range(4, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    off = {}
    for k, counts in level.items():
        n = [None, *(sum(v == i for v in counts.values()) for i in range(1, 5))]
        good = n[1] and n[2]
        off[k] = [0.0, *(max(0.0, i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i]) if good and n[i] else i / 2 for i in range(1, 4))]
    return level, off


def _model(texts):
    level, off = _tables(texts)
    by = {k: defaultdict(list) for k in level}
    for k, counts in level.items():
        for g, v in counts.items():
            by[k][g[:-1]].append(v)

    def chance(context, char):
        if not len(context) + 1:
            return None
        k = len(context) + 1
        below = chance(context[1:], char) if k > 1 else 1 / (len(level[1]) + 1)
        seen = by[k].get(context)
        if not seen:
            return below
        total, a = sum(seen), level[k].get(context + char, 0)
        weight = sum(off[k][min(v, 3)] for v in seen) / total
        return max(0, a - off[k][min(a, 3)]) / total + weight * below

    return chance


def test_counts(spark, docs, awkward):
    rnd = random.Random(1)
    texts = ["a b c a b c", "a b\na b\n\n \na b\r\na b", "x x x x", "# <b> | & $$", "", "one\ntwo\none\none", "a\x1cb\x85c\xa0d a b c", "é é é é 日本 日本 日本"]
    texts += ["".join(rnd.choices("ab \n#", k=rnd.randint(1, 80))) for _ in range(200)]
    got = {r.doc_id: tuple(r[c] for c in rules.COUNTS) for r in rules.scored(docs(*texts)).collect()}
    assert got == {i: _counts(t) for i, t in enumerate(texts)}
    odd = rules.judged(awkward).collect()
    assert sorted(map(repr, ((r.doc_id, *(r[c] for c in rules.COUNTS)) for r in odd))) == sorted(map(repr, ((i, *_counts(t)) for i, t, *_ in AWKWARD)))
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in odd)


def test_probabilities_equal_a_plain_model(corpus):
    rows, df = corpus
    fold = {(r.doc_id, r.lang): (r.text, r.fold) for r in rules.folded(df).collect()}
    texts = defaultdict(list)
    for i, t, lang in rows:
        text, f = fold[i, lang or ""]
        texts[lang or "", f].append(" ".join(WORD.findall(text)))
    models = {key: _model(t) for key, t in texts.items()}
    for r in rules.scored(df).collect():
        text, f = fold[r.doc_id, r.lang]
        flat = " ".join(WORD.findall(text))
        chance = models.get((r.lang, 1 - f))
        if chance is None or not flat:
            assert r.score is None and r.n_chars_scored is None
            continue
        full = "\n" * 4 + flat
        expected = -sum(math.log(chance(full[i - 4:i], full[i])) for i in range(4, len(full)))
        assert r.n_chars_scored == len(flat) and abs(r.score / rules.UNIT - expected) < 1e-4 * len(flat)
    for context in ("\n\n\n\n", "aben", "qqqq", "日"):
        chance = models["en", 0]
        known = {c for t in texts["en", 0] for c in t}
        assert abs(sum(chance(context[-4:], c) for c in known) + chance(context[-4:], "☃") - 1) < 1e-9


def test_a_model_in_slices_gives_the_same(corpus, awkward):
    for df, n in ((corpus[1], 2000), (awkward, 300)):
        whole, slices = (sorted(map(repr, rules.scored(df, k).select("doc_id", "lang", *rules.COUNTS, "score", "n_chars_scored").collect())) for k in (rules.ENTRIES, n))
        assert whole == slices


def test_verdicts(corpus, nothing):
    got = {r.doc_id: r for r in rules.judged(corpus[1]).collect()}
    assert not got[201].kept and not got[201].base_failed and got[201].log_perplexity > got[201].upper
    assert not got[200].kept and got[200].log_perplexity > got[200].upper
    assert all(r.kept != r.base_failed for i, r in got.items() if i < 200) and sum(r.kept for r in got.values()) > 100
    assert rules.judged(nothing).count() == 0


def test_sequences_of_any_alphabet():
    rnd = random.Random(9)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) for _ in range(3)] + ["ab", ""]
    doc, place, codes = rules.collapsed(ta.Texts(texts))
    got = Counter()
    for table, counts, owner in rules.counted_grams(place, codes, doc):
        for g, n, o in zip(rules._strings(table), counts.tolist(), owner.tolist()):
            got[o, g] += n
    expected = Counter((i, f"{chr(10) * 4}{t}"[j:j + 5]) for i, t in enumerate(texts) for j in range(len(t)))
    assert got == expected
