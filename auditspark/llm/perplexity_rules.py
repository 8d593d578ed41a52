"""Quality rules on whole texts, and perplexity under a modified Kneser-Ney model of the corpus itself.

The model predicts each character from the four before it, in texts whose white space is collapsed to single spaces;
a text begins after four line breaks. Spark counts the five-character sequences of all documents by language and by fold (a
document's fold is a bit of the hash of its text, so copies share it), and derives from them by aggregates and joins the
continuation counts, the three discounts, the context weights and the interpolated probabilities of all orders. A
document is scored by the model of the other fold, which hasn't seen it.

Probabilities and context weights are stored as 64-bit hashes in sorted arrays with fixed-point logarithms beside them. A
task holds about ENTRIES entries: a larger model is dealt into slices by the three characters before the predicted one (the
few sequences that are shorter go to all), and the documents are read once for each slice, which scores the places that
are its own. Logarithms are whole numbers, so any number of slices gives the same sums.

Documents that pass the base rules set the bands of their language: the median of their log perplexity, and the median
distance from it as its spread. A document below median - LOW spreads or above median + HIGH spreads is rejected; a text of n characters
is given SHORT / sqrt(n) more room, since means over few characters differ more.

Defined cases: a null text is empty; an empty text has no words and fails the base rules; a null language is the language ''; a language
whose documents all lie in one fold, or which has fewer than LEAST judged documents, has no bands and its documents are judged
by the base rules alone; rows are judged one by one, so copies share a verdict; texts are read whole, in parts of about
400,000 characters of memory unless one text is longer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm import text_arrays as ta
from auditspark.llm.common import stored, text_or_empty
from auditspark.session import ship_package

ORDER = 5
FOLDS = 2
#: Entries (12 bytes each) of a slice of the model, all of which is sent to every task.
ENTRIES = 8_000_000
#: Characters before a place that decide its slice, and a multiplier that spreads their numbers.
NEAR, SPREAD = 3, 8191
#: Entries of one sorted array.
SHARD = 500_000
#: Logarithms are counted in these parts of a nat.
UNIT = 1 << 16
#: Steps of log perplexity in which medians are taken.
STEP = 1000
LOW, HIGH, LEAST = 8, 8, 30
#: Bands are sent to every task up to this many languages, and joined beyond.
LANGUAGES = 10_000
#: Nats of room that a text of one character has besides.
SHORT = 1.0
#: A band's spread is this many steps at least, a hundredth of a nat.
LEAST_SPREAD = 10
MIN_WORDS, MAX_REPEATED = 50, 50  # words, percent of words: fixed by the contract

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_LAG = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]  # odd multipliers (fixed values)
_BEGIN = np.uint32(10)  # a line break is never left in a collapsed text


def base_counts(t: ta.Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    ends = np.flatnonzero(t.codes == 10)
    lines = np.concatenate([[0], ends[:-1] + 1])
    used = np.add.reduceat(t.solid, lines, dtype=np.int64) > 0
    line_doc = t.doc[lines][used]
    _, later = ta.repeated(ta.pairs(ta.run_hashes(t.codes, lines)[used], line_doc))
    words = ta.run_hashes(t.codes, t.word_starts, t.solid)
    again = np.zeros(len(words), bool)
    if len(words) > 2:
        whole = t.word_doc[2:] == t.word_doc[:-2]
        key = ta.mixed(ta.mixed(words[:-2] + np.uint64(1)) + words[1:-1])
        twice, _ = ta.repeated(ta.pairs(ta.mixed(key + np.uint64(3)) + words[2:], t.word_doc[2:])[whole])
        found = np.flatnonzero(whole)[twice]
        for k in range(3):
            again[found + k] = True
    return {"n_words": np.bincount(t.word_doc, minlength=t.n), "word_chars": t.per_text(t.solid),
            "n_symbols": t.per_text((t.codes < 256) & _SYMBOL[np.minimum(t.codes, 255)]),
            "n_dup_lines": np.bincount(line_doc[later], minlength=t.n), "n_repeat_words": np.bincount(t.word_doc[again], minlength=t.n)}


def collapsed(t: ta.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, code point) of each character of the texts with single spaces."""
    kept = t.solid.copy()
    new_text = np.ones(len(t.word_starts), bool)
    new_text[1:] = t.word_doc[1:] != t.word_doc[:-1]
    kept[t.word_starts[~new_text] - 1] = True  # one space before each word but a text's first
    codes = np.where(t.solid, t.codes, np.uint32(32))[kept]
    doc = t.doc[kept]
    sizes = np.bincount(doc, minlength=t.n)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return doc, place, codes


def lagged(values: np.ndarray, place: np.ndarray, begin) -> list[np.ndarray]:
    """The values 0 to 4 places before each place; *begin* stands before a text."""
    lags, near = [values], np.flatnonzero(place < ORDER - 1)
    for j in range(1, ORDER):
        lag = np.empty_like(values)
        lag[j:] = values[:-j]
        lag[near[place[near] < j]] = begin
        lags.append(lag)
    return lags


def alphabet(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the code points that occur, and the line break, in order; the place of each code point among them)."""
    there = np.zeros(max(int(codes.max(initial=0)), int(_BEGIN)) + 1, bool)
    there[codes] = there[_BEGIN] = True
    return np.flatnonzero(there).astype(np.uint32), np.cumsum(there) - 1


def gram_hash(lags: list[np.ndarray]) -> np.ndarray:
    """Hash of the sequence whose last character's code mix is in lags[0]."""
    total = np.full(len(lags[0]) if lags else 1, len(lags), np.uint64)
    for code, factor in zip(lags, _LAG):
        total += code * factor
    return ta.mixed(total)


def code_mix(codes: np.ndarray) -> np.ndarray:
    return ta.mixed(codes.astype(np.uint64) + np.uint64(1))


def counted_grams(place: np.ndarray, codes: np.ndarray, owner: np.ndarray | None = None) -> Iterator[tuple]:
    """(sequences, how often, whose) of the distinct sequences: exact, by packing characters into bits as far as the alphabet allows."""
    n = len(codes)
    if not n:
        return
    letters, rank = alphabet(codes)
    bits = max(1, int(len(letters) - 1).bit_length())
    low, high = (0, 0) if owner is None else (int(owner[0]), int(owner[-1]))
    if bits * ORDER + (high - low).bit_length() > 63:
        if high > low:  # fewer texts at a time
            cut = int(np.searchsorted(owner, (low + high + 1) // 2))
            yield from counted_grams(place[:cut], codes[:cut], owner[:cut])
            yield from counted_grams(place[cut:], codes[cut:], owner[cut:])
            return
        table, counts = np.unique(np.column_stack([*reversed(lagged(codes, place, _BEGIN))]), axis=0, return_counts=True)
        yield table, counts, np.full(len(table), low)
        return
    key = np.zeros(n, np.int64) if owner is None else owner.astype(np.int64) - low
    here, near = rank.astype(np.int32)[codes], np.flatnonzero(place < ORDER - 1)
    for j in range(ORDER - 1, -1, -1):  # one lag at a time, to hold few arrays of a part
        key <<= bits
        if j:
            lag = np.empty_like(here)
            lag[j:] = here[:-j]
            lag[near[place[near] < j]] = rank[_BEGIN]
            key |= lag
        else:
            key |= here
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, counts = key[first], np.diff(first, append=n)
    table = np.column_stack([letters[(key >> bits * j) & ((1 << bits) - 1)] for j in range(ORDER - 1, -1, -1)])
    yield table, counts, (key >> bits * ORDER) + low


def _strings(table: np.ndarray) -> list[str]:
    text = np.ascontiguousarray(table, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i:i + ORDER] for i in range(0, len(text), ORDER)]


def _groups(batch: pa.RecordBatch) -> dict[tuple, list[int]]:
    """Rows of a batch by language and fold."""
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist())):
        found.setdefault(key, []).append(i)
    return found


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and fold of every row."""
    return docs.select("doc_id", text_or_empty().alias("text"), F.coalesce("lang", F.lit("")).alias("lang"),
                       F.pmod(F.xxhash64(text_or_empty()), F.lit(FOLDS)).cast("int").alias("fold"))


def grams(docs: DataFrame) -> DataFrame:
    """lang, fold, gram, n: the sequences of five characters of all documents, counted by batch and then by Spark."""
    ship_package(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for (lang, fold), mine in _groups(batch).items():
                own = [texts[i] for i in mine]
                found = []
                for a, b in ta.parts(own, 5 * ta.PART):
                    found += [x[:2] for x in counted_grams(*collapsed(ta.Texts(own[a:b]))[1:])]
                for table, counts in found:
                    k = len(table)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), k), pa.array(np.full(k, fold, np.int32)), pa.array(_strings(table)), pa.array(counts)],
                                                     ["lang", "fold", "gram", "n"])

    part = folded(docs).select("text", "lang", "fold").mapInArrow(rows, "lang string, fold int, gram string, n long")
    return part.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def _discount(i: int) -> Column:
    """Modified Kneser-Ney discount of sequences counted i times (3: three times or more), from the counts of counts."""
    here, more = F.col(f"n{i}"), F.col(f"n{i + 1}")
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (here > 0), F.greatest(F.lit(0.0), i - (i + 1) * y * more / here)).otherwise(F.lit(i / 2))


def model(counts: DataFrame) -> DataFrame:
    """lang, fold, kind (g: sequence, c: context), gram, value: fixed-point negative logarithms of probabilities and of context weights.

    *counts* has lang, fold, gram, n. The empty sequence's value is that of an unknown character.
    """
    key = ["lang", "fold"]
    level = {ORDER: stored(counts.select(*key, "gram", F.col("n").alias("a")))}
    for k in range(ORDER - 1, 0, -1):  # distinct sequences that end so
        level[k] = stored(level[k + 1].groupBy(*key, F.right("gram", F.lit(k)).alias("gram")).agg(F.count(F.lit(1)).alias("a")))
    logged = lambda p: F.round(-F.log(p) * UNIT).cast("int")
    lower = level[1].groupBy(*key).agg((1 / (F.count(F.lit(1)) + 1)).alias("p")).withColumn("gram", F.lit(""))
    entries = [lower.select(*key, F.lit("g").alias("kind"), "gram", logged(F.col("p")).alias("value"))]
    for k in range(1, ORDER + 1):
        rows = level[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("below", F.substring("gram", 2, k - 1))
        discounts = rows.groupBy(*key).agg(*(F.count(F.when(F.col("a") == i, 1)).alias(f"n{i}") for i in range(1, 5))).select(*key, *(_discount(i).alias(f"d{i}") for i in range(1, 4)))
        one = Window.partitionBy(*key, "context")  # as many rows as the alphabet has letters, at most
        off = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = [F.count(F.when(F.col("a") == i if i < 3 else F.col("a") >= 3, 1)).over(one) * F.col(f"d{i}") for i in range(1, 4)]
        first = F.row_number().over(one.orderBy("gram")) == 1
        shares = rows.join(discounts, key).withColumn("s", F.sum("a").over(one)).select(
            *key, F.left("gram", F.lit(1)).alias("head"), "below", ((F.col("a") - off) / F.col("s")).alias("own"), ((seen[0] + seen[1] + seen[2]) / F.col("s")).alias("weight"), first.alias("first"))
        lower = stored(shares.join(lower.select(*key, F.col("gram").alias("below"), F.col("p").alias("q")), [*key, "below"]).select(
            *key, F.concat("head", "below").alias("gram"), "weight", "first", (F.col("own") + F.col("weight") * F.col("q")).alias("p")))
        entries.append(lower.select(*key, F.lit("g").alias("kind"), "gram", logged(F.col("p")).alias("value")))
        entries.append(lower.where("first").select(*key, F.lit("c").alias("kind"), F.substring("gram", 1, k - 1).alias("gram"),
                                                   logged(F.greatest(F.col("weight"), F.lit(1e-9))).alias("value")))
    out = entries[0]
    for more in entries[1:]:
        out = out.unionAll(more)
    return out


def slice_of(entries: DataFrame, number: int, slices: int) -> DataFrame:
    """The entries that the places of one slice need: those whose three characters before the last one (a context's last ones) fall in it, and shorter ones."""
    long_ = F.length("gram") + F.when(F.col("kind") == "c", 1).otherwise(0) > NEAR
    near = F.when(F.col("kind") == "c", F.right("gram", F.lit(NEAR))).otherwise(F.substring(F.right("gram", F.lit(NEAR + 1)), 1, NEAR))
    at = F.pmod(_places(near), F.lit(slices))
    return entries.where(~long_ | (at == number))


def _places(near: Column) -> Column:
    """A number of the three characters, as slice_numbers() gives it."""
    total = F.lit(0).cast("long")
    for j in range(NEAR):
        total = total * SPREAD + F.ascii(F.substring(near, j + 1, 1))
    return F.shiftright(total * SPREAD, 7) % (1 << 20)


def slice_numbers(lags: list[np.ndarray], slices: int) -> np.ndarray:
    """The slice of each place, by the characters 3, 2 and 1 before it."""
    total = np.zeros(len(lags[0]), np.int64)
    for lag in (lags[j] for j in range(NEAR, 0, -1)):
        total = total * SPREAD + lag
    return (total * SPREAD >> 7) % (1 << 20) % slices


def packed(entries: DataFrame, n: int) -> DataFrame:
    """lang, fold, kind, hashes (sorted, 64-bit), values (32-bit): arrays of about SHARD entries of *n* at most."""
    ship_package(entries.sparkSession)

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = np.empty(len(pdf), np.uint64)
        sizes = pdf["gram"].str.len().to_numpy()
        for k in range(ORDER + 1):
            at = np.flatnonzero(sizes == k)
            codes = np.frombuffer("".join(pdf["gram"].iloc[at]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), k)
            if len(at):
                hashes[at] = gram_hash([code_mix(codes[:, k - 1 - j]) for j in range(k)])
        order = np.argsort(hashes)
        head = {c: [pdf[c].iloc[0]] for c in ("lang", "fold", "kind")}
        return pd.DataFrame(head | {"hashes": [hashes[order].tobytes()], "values": [pdf["value"].to_numpy(np.int32)[order].tobytes()]})

    shard = F.pmod(F.xxhash64("gram"), F.lit(n // SHARD + 1))
    return entries.groupBy("lang", "fold", "kind", shard).applyInPandas(rows, "lang string, fold int, kind string, hashes binary, values binary")


class Lookup:
    """Sorted hash arrays of one language and fold, with an index of the leading bits."""

    def __init__(self, shards: dict[str, list[tuple[bytes, bytes]]]):
        self.arrays = {}
        for kind in "gc":
            own = shards.get(kind, [])
            hashes, values = (np.concatenate([np.empty(0, t), *(np.frombuffer(s[i], t) for s in own)]) for i, t in enumerate((np.uint64, np.int32)))
            order = np.argsort(hashes)
            known, bits = hashes[order], max(4, len(hashes).bit_length() - 1)
            shift = np.uint64(64 - bits)
            starts = np.searchsorted(known >> shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
            self.arrays[kind] = np.append(known, np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(values[order], np.int32(0)), shift, starts

    def find(self, kind: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, is there one) of each hash."""
        known, values, shift, starts = self.arrays[kind]
        at = starts[hashes >> shift]
        met = known[at]
        open_ = np.flatnonzero(met < hashes)
        while len(open_):  # a step or two: hashes are spread evenly
            at[open_] += 1
            met[open_] = known[at[open_]]
            open_ = open_[met[open_] < hashes[open_]]
        there = (met == hashes) & (at < len(known) - 1)
        return np.where(there, values[at], 0), there

    def scores(self, place: np.ndarray, codes: np.ndarray, number: int = 0, slices: int = 1) -> np.ndarray:
        """Negative logarithm of each character's probability: the longest known sequence's, and the weights of the contexts left for it; 0 for places of other slices."""
        letters, rank = alphabet(codes)
        lags = lagged(code_mix(letters)[rank[codes]], place, code_mix(np.array([_BEGIN]))[0])
        total, open_ = np.zeros(len(codes), np.int64), np.arange(len(codes))
        if slices > 1:
            open_ = np.flatnonzero(slice_numbers(lagged(codes.astype(np.int64), place, int(_BEGIN)), slices) == number)
            lags = [x[open_] for x in lags]
        for k in range(ORDER, -1, -1):
            value, there = self.find("g", gram_hash(lags[:k]) if k else np.repeat(gram_hash([]), len(open_)))
            total[open_] += value
            if there.all():
                break
            open_, lags = open_[~there], [x[~there] for x in lags]
            if k:
                value, _ = self.find("c", gram_hash(lags[1:k]) if k > 1 else np.repeat(gram_hash([]), len(open_)))
                total[open_] += value
        return total


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COUNTED = ", ".join(f"{c} long" for c in COUNTS) + ", n_chars_scored long, score long"


def _scored(rows: DataFrame, entries: DataFrame, n: int, number: int = 0, slices: int = 1) -> DataFrame:
    """doc_id, lang, text_key, the counts, and the score by one slice of the model."""
    ship_package(rows.sparkSession)
    shards: dict[tuple, dict] = {}
    for r in packed(slice_of(entries, number, slices) if slices > 1 else entries, n).collect():  # about ENTRIES entries
        shards.setdefault((r.lang, r.fold), {}).setdefault(r.kind, []).append((bytes(r.hashes), bytes(r["values"])))
    model_ = rows.sparkSession.sparkContext.broadcast(shards)

    def scored(batches):
        known: dict[tuple, Lookup] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = {c: np.zeros(batch.num_rows, np.int64) for c in (*COUNTS, "n_chars_scored", "score")}
            judged = np.zeros(batch.num_rows, bool)
            for (lang, fold), mine in _groups(batch).items():
                key = (lang, (fold + 1) % FOLDS)
                if key not in known and key in model_.value:
                    known[key] = Lookup(model_.value[key])
                own = [texts[i] for i in mine]
                for a, b in ta.parts(own):
                    at, t = np.array(mine[a:b]), ta.Texts(own[a:b])
                    if not number:
                        for c, values in base_counts(t).items():
                            out[c][at] = values
                    if key in known:
                        doc, place, codes = collapsed(t)
                        sums = np.concatenate([[0], np.cumsum(known[key].scores(place, codes, number, slices))])
                        sizes = np.bincount(doc, minlength=t.n)
                        ends = np.cumsum(sizes)
                        out["score"][at], out["n_chars_scored"][at], judged[at] = sums[ends] - sums[ends - sizes], sizes, sizes > 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "text_key")), *(pa.array(out[c], mask=None if c in COUNTS else ~judged) for c in out)],
                                             ["doc_id", "lang", "text_key", *out])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, lang string, text_key string, {_COUNTED}")


def scored(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """doc_id, lang, the counts, n_chars_scored and score of every row, both null if no model judges it."""
    table = stored(model(grams(docs)))
    n = table.count()
    slices = n // entries + 1
    rows = folded(docs).withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256) if slices > 1 else F.lit(None).cast("string"))
    first = _scored(rows, table, n, 0, slices)
    if slices == 1:
        return first.drop("text_key")
    first = stored(first)
    parts = [first.select("text_key", "lang", "score").distinct()]  # rows of one text and language have equal parts
    for number in range(1, slices):
        parts.append(stored(_scored(rows, table, n, number, slices).select("text_key", "lang", "score").distinct()))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionAll(more)
    sums = whole.groupBy("text_key", "lang").agg(F.sum("score").alias("score"))
    return first.drop("score").join(sums, ["text_key", "lang"], "left").drop("text_key")


def _median(buckets: DataFrame, name: str) -> DataFrame:
    """Lower median of the steps in *name* by language, from how often each step comes."""
    up = Window.partitionBy("lang").orderBy(name)
    whole = buckets.withColumn("to_here", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return whole.where(2 * F.col("to_here") >= F.col("all")).groupBy("lang").agg(F.min(name).alias("median"), F.max("all").alias("n_judged"))


def bands(judged: DataFrame) -> DataFrame:
    """lang, lower, upper: steps of log perplexity, from rows of lang and step; languages of LEAST rows or more."""
    buckets = stored(judged.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")))  # a few thousand steps a language at most
    middle = _median(buckets, "step").where(F.col("n_judged") >= LEAST)
    off = buckets.join(middle.select("lang", "median"), "lang").groupBy("lang", F.abs(F.col("step") - F.col("median")).alias("off")).agg(F.sum("n").alias("n"))
    spread = _median(off, "off").select("lang", F.greatest("median", F.lit(LEAST_SPREAD)).alias("spread"))
    return middle.join(spread, "lang").select("lang", (F.col("median") - LOW * F.col("spread")).alias("lower"), (F.col("median") + HIGH * F.col("spread")).alias("upper"))


def judged(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """doc_id, the counts, base_failed, kept, log_perplexity (of a character, in nats) and the band it was held against."""
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    step = F.when(F.col("n_chars_scored") > 0, F.floor(F.col("score") * STEP / (F.col("n_chars_scored") * UNIT)))
    rows = stored(scored(docs, entries).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeated).withColumn("step", step))
    limits = stored(bands(rows.where(~F.col("base_failed") & F.col("step").isNotNull()).select("lang", "step")))
    limits = F.broadcast(limits) if limits.count() <= LANGUAGES else limits  # a language may hold most rows
    room = F.lit(SHORT * STEP) / F.sqrt("n_chars_scored")
    inside = F.col("step").between(F.col("lower") - room, F.col("upper") + room)
    return rows.join(limits, "lang", "left").select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
                                                   (F.col("step") / STEP).alias("log_perplexity"), (F.col("lower") / STEP).alias("lower"), (F.col("upper") / STEP).alias("upper"))
