"""Patterns with cheap tests in front find what the plain ones find, and the dear test of a boundary is not made everywhere."""

import random
import re

from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions.starts import quick
from auditspark.functions.text import any_of


def _patterns():
    found = [p for v in vars(fv).values() for p in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else [v])]
    return sorted({p for p in found if isinstance(p, str) and "\\" in p})


def _texts(patterns, n=220):
    rng = random.Random(5)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z_@./'\"-]{3,}", p)})
    glue = [" ", "\n", ".", "(", "_", "'", '"', "", "", "=", " = [", "́", "é", " ", "\U0001d7d8", "9", "@", ":", "/", "-"]
    odd = ["ſ", "K", "İ", "ı", "SELECT a FROM b", "x = Agent(", "sk-" + "a1" * 12, "import openai", "os.environ['A_KEY']"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(glue) + rng.choice((str, str.upper, str.title))(rng.choice(words if rng.random() < 0.9 else odd)) for _ in range(14)]
        text = "".join(parts)
        texts.append(text.replace("s", "ſ", 2).replace("K", "K", 1).replace("i", "ı", 1) if rng.random() < 0.2 else text)
    return [*texts, "", *odd]


def test_same_matches_at_the_same_places(spark):
    patterns = _patterns()
    assert len(patterns) > 140
    df = spark.createDataFrame([(t,) for t in _texts(patterns)], "t string").repartition(4).cache()
    found = 0
    for flags in ("(?dU)", "(?d)"):
        for at in range(0, len(patterns), 20):
            part = patterns[at:at + 20]
            seen = lambda p: F.struct(F.regexp_extract_all("t", F.lit(flags + p), F.lit(0)).alias("all"), F.regexp_instr("t", F.lit(flags + p)).alias("at"))
            rows = df.select("t", *[F.struct(seen(p).alias("plain"), seen(quick(p)).alias("quick")).alias(f"p{i}") for i, p in enumerate(part)]).collect()
            for row in rows:
                for i, p in enumerate(part):
                    assert row[f"p{i}"].plain == row[f"p{i}"].quick, (p, quick(p), row.t)
                    found += bool(row[f"p{i}"].plain["all"])
    df.unpersist()
    assert found > 500


def test_groups_keep_their_numbers():
    for p in _patterns():
        assert re.compile(quick(p)).groups == re.compile(p).groups, p


def test_no_boundary_before_its_word():
    """Every alternative of these had a boundary tested at every place of a text."""
    for p in (fv.OBSERVABILITY, fv.CONTROL_PATTERNS["CTRL001"], fv.CONTROL_PATTERNS["CTRL003"], fv.MODEL_CALL):
        assert not re.search(r"(?:^|\||\))\\b(?=\w)", re.sub(r"\(\?=[^)]*\)\\b", "", quick(p))), p
        assert quick(p).startswith(("(?:(?=[", "(?i)(?:(?=["))
    assert quick(r"\bfoo\d|\bbars?\b|[_-]x") == r"(?=foo)\bfoo\d|(?=bar)\bbars?\b|[_-]x"
    assert quick(r"\bx?y|\b(?:a|b)?c|\w+") == r"\bx?y|\b(?:a|b)?c|\w+"


def test_tree_of_many_beginnings_prefers_the_longest():
    words = [a + "x" for a in "abcdefghijklmnop-'/@"] + ["ax1", "cxy", "c"]
    text = "".join(sorted(words)) + "zz ax12 -x"
    plain = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    assert re.findall(f"(?=({any_of(words)}))", text) == re.findall(f"(?=({plain}))", text)
