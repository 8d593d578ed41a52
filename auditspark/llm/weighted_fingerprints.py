"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by their counts. For every sample k and word, hashes give r and c (Gamma(2,1), each as
-ln of a product of two uniforms) and b (uniform); with t = floor(ln(weight) / r + b) the word's value is
ln(c) - r (t - b + 1). The word of smallest value and its t are the sample. Two documents share a sample with a probability equal to
their generalised Jaccard similarity, sum of the smaller weights over sum of the larger ones.

A sample is kept as one number: the value in steps of 2^-26 above 24 bits of a hash of word and t. Equal numbers
mean the same word and t, for the value follows from both.

Defined cases: null text is the empty text; texts without words have the fingerprint of zeros only and likeness 1 to
each other, 0 to others; words are runs without ASCII white space, in the given case; the next document is that
of the next smaller doc_id (rows of one doc_id in the order of their texts, null ids last), after the last one comes
the first, and a single row follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import WORD, text_or_empty

SAMPLES = 64
#: Ranges of doc_id for each shuffle partition.
RANGES = 4


def _uniform(bits: Column, width: int) -> Column:
    """Middle of one of 2^width equal steps of (0, 1)."""
    return (bits + F.lit(0.5)) * F.lit(2.0**-width)


def sample(k: int, word: Column, log_weight: Column) -> Column:
    """The number of sample *k* for one weighted word; the document's is the smallest."""
    h = F.xxhash64(word, F.lit(2 * k))
    g = F.xxhash64(word, F.lit(2 * k + 1))
    r = -F.log(_uniform(F.shiftrightunsigned(h, 32), 32) * _uniform(h.bitwiseAND(F.lit(0xFFFFFFFF)), 32))
    c = -F.log(_uniform(F.shiftrightunsigned(g, 42), 22) * _uniform(F.shiftrightunsigned(g, 21).bitwiseAND(F.lit(0x1FFFFF)), 21))
    b = _uniform(g.bitwiseAND(F.lit(0x1FFFFF)), 21)
    t = F.floor(log_weight / r + b)
    value = F.log(c) - r * (t - b + 1)
    tag = word.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFF))
    return F.floor(value * 2.0**26).cast("long") * F.lit(1 << 24) + tag


def weighted_words(hashes: str) -> Column:
    """array<struct<word, n, sides>> of a sorted array of word hashes whose lowest bit is the side (0 text, 1 edited text).

    n is the word's count in a side; sides is 1, 2 or 3 for text, edited text or both with the same count.
    """
    h = F.col(hashes)
    starts = F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (x != F.get(h, i - 1)), i)), lambda s: s.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(h)))
    return F.transform(F.arrays_zip(starts, ends), lambda p: F.struct(F.get(h, p["0"]).alias("word"), (p["1"] - p["0"]).alias("n")))


def joined_sides(runs: str) -> Column:
    """Runs of both sides of a word become one where their counts are equal."""
    r = F.col(runs)
    same = lambda x, y: (F.shiftright(x["word"], 1) == F.shiftright(y["word"], 1)) & (x["n"] == y["n"])

    def of(x: Column, i: Column) -> Column:
        edited = x["word"].bitwiseAND(F.lit(1)) == 1
        word = x["word"].bitwiseAND(F.lit(-2))
        after, before = F.coalesce(same(x, F.get(r, i + 1)), F.lit(False)), F.coalesce(same(x, F.get(r, i - 1)), F.lit(False))
        return F.when(~edited, F.struct(word.alias("word"), x["n"].alias("n"), F.when(after, 3).otherwise(1).alias("sides"))).when(
            ~before, F.struct(word.alias("word"), x["n"].alias("n"), F.lit(2).alias("sides")))

    return F.filter(F.transform(r, of), lambda w: w.isNotNull())


def range_bounds(keys: DataFrame, n: int) -> list[int]:
    """At most *n* values of the key that cut it into ranges of similar numbers of rows, the largest one included."""
    at = [(i + 1) / n for i in range(n)]
    got = keys.agg(F.percentile_approx("_key", at, max(10_000, 4 * n)).alias("q"), F.max("_key").alias("m")).first()
    return sorted({*got["q"], got["m"]}) if got["m"] is not None else []


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key, by halving."""
    cut = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(cut, at + s - 1) < key, at + s).otherwise(at))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text and next (text of the next row), _range and _place; whole texts are shuffled once.

    Ranges of doc_id end at ids that occur, so the row that follows a range's last one is known: that whose id is the bound
    of the range below. It is sent to both ranges, and the very first row to the lowest range as well. These copies
    stay in the result, with a null next, for the caller to look at and drop.
    """
    keyed = docs.select(F.col("doc_id"), text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_key"))
    bounds = range_bounds(keyed.select("_key"), ranges)
    if not bounds:
        bounds = [0]
    home, ends = range_of(F.col("_key"), bounds), F.array(*[F.lit(b).cast("long") for b in bounds])
    copy = F.when(F.get(ends, F.col("_home")) == F.col("_key"), F.pmod(F.col("_home") + 1, F.lit(len(bounds))))
    to = F.array_compact(F.array(F.struct(F.col("_home").alias("range"), F.lit(False).alias("copy")),
                                 F.when(copy.isNotNull(), F.struct(copy.alias("range"), F.lit(True).alias("copy")))))
    sent = keyed.withColumn("_home", home).select("doc_id", "text", "_key", F.explode(to).alias("_to")).select(
        "doc_id", "text", "_key", F.col("_to.range").alias("_range"), F.col("_to.copy").alias("_copy"))
    order = Window.partitionBy("_range").orderBy("_copy", F.col("_key").desc(), "text")
    return sent.select("doc_id", "text", "_range", "_copy", F.row_number().over(order).alias("_place"),
                       F.when(~F.col("_copy"), F.lead("text").over(order)).alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document. Words are
    counted inside their row; each word becomes one row (one for both texts if its counts are equal) with its samples,
    and a hash aggregate takes the smallest ones within the partition that the one shuffle has made.
    """
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    pieces = [F.conv(F.substring("_sha", 1 + 13 * i, 13), 16, 10).cast("long").alias(f"_sha{i}") for i in range(5)]  # numbers, as hash aggregates keep no strings
    both = with_next(docs, ranges).withColumn("_edited", edited).select(
        "*", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("_sha"))
    carried = ["doc_id", "n_chars", *[f"_sha{i}" for i in range(5)]]
    side = lambda text, bit: F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    hashes = F.sort_array(F.concat(side(F.col("text"), 0), side(F.when(F.col("_copy"), "").otherwise(F.col("_edited")), 1)))
    runs = both.select("_range", "_place", "_copy", "doc_id", "n_chars", *pieces, hashes.alias("_hashes")).withColumn("_runs", weighted_words("_hashes"))
    words = runs.select("_range", "_place", "_copy", *carried, F.explode_outer(joined_sides("_runs")).alias("_w"))
    weighed = words.select("_range", "_place", "_copy", *carried, F.col("_w.word").alias("_word"), F.coalesce("_w.sides", F.lit(3)).alias("_sides"), F.log(F.col("_w.n").cast("double")).alias("_weight"))
    lows = [F.min(sample(k, F.col("_word"), F.col("_weight"))).alias(f"_s{k}") for k in range(SAMPLES)]
    signed = weighed.groupBy("_range", "_place", "_copy", "_sides").agg(*[F.max(c).alias(c) for c in carried], *lows)
    of_side = lambda bit: [F.min(F.when(F.col("_sides").bitwiseAND(F.lit(bit)) > 0, F.col(f"_s{k}"))).alias(f"_{bit}s{k}") for k in range(SAMPLES)]
    whole = signed.groupBy("_range", "_place", "_copy").agg(*[F.max(c).alias(c) for c in carried], *of_side(1), *of_side(2))
    as_array = lambda bit: F.array(*[F.coalesce(f"_{bit}s{k}", F.lit(0)) for k in range(SAMPLES)])
    arrays = whole.select("_range", "_place", "_copy", *carried, as_array(1).alias("_print"), as_array(2).alias("_edited"))
    rows = arrays.withColumn("_next", F.lead("_print").over(Window.partitionBy("_range").orderBy("_place")))
    hexed = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")
    like = lambda c: F.size(F.filter(F.zip_with("_print", c, lambda x, y: x == y), lambda same: same)) / F.lit(float(SAMPLES))
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"_sha{i}")), 13 if i < 4 else 12, "0") for i in range(5)])
    return rows.where("not _copy").select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), hexed("_print").alias("fingerprint"), hexed("_edited").alias("edited_fingerprint"),
        like("_edited").alias("near_edited"), like("_next").alias("near_next"))
