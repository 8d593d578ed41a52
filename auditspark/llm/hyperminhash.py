"""Near-duplicate documents by HyperMinHash.

Each document's set of word shingles is hashed; the smallest hash of each of 256 buckets is kept as a register of 16
bits: its count of leading zeros and ten mantissa bits. Empty buckets borrow the register of the first full bucket in a
fixed random order, so that short texts band as well as long ones. Five registers make a band; documents that share
a band are candidates; a Jaccard estimate from equal registers, corrected for accidental equality, comes before the
check on full sets. Two documents at a Jaccard similarity of exactly 0.8 share no band with a chance of
(1 - 0.8^5)^51, about 2e-9; the estimate must be six standard deviations low to lose them.

Equal sets are one class, found by a digest of the set, so copies never form pairs. A group of near copies isn't
expanded into pairs either: each band's documents are first compared with the one document of the band that is in
most and largest bands (the text the others were copied from, as a rule). Only documents that this leaves in different
components are compared further, in blocks of bounded size inside tasks, which emit links and no pairs.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; fewer words
than a shingle form one shingle; rows that share a doc_id count as one document; rows without a doc_id take part under
an id made of their text, and their component is named by its smallest doc_id, or null if it has none; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import map_batches, text_or_empty
from auditspark.session import cut_lineage, ship_package

REGISTERS, BAND, MANTISSA = 256, 5, 10
BANDS = REGISTERS // BAND
#: Documents of a block in the second comparison.
BLOCK = 256
#: The estimate's slack below the threshold: six times sqrt(0.8 * 0.2 / 256).
SLACK = 0.15
#: Cells of a block's table of shingles by documents; larger ones are compared pair by pair.
DENSE = 100_000_000
#: Chance that two unrelated registers are equal: the same zero count (about one half) and the same mantissa.
ACCIDENT = 0.5 / 2**MANTISSA
#: Words whose hashes a task remembers.
CACHE = 500_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ORDER = np.argsort(np.random.default_rng(5).random((REGISTERS, REGISTERS)), axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Texts to sorted distinct shingle hashes; remembers the hashes of words."""

    def __init__(self, words: int):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i:i + n] + np.uint64(i))
        return np.unique(_mixed(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 256 registers of a non-empty sorted set."""
    bucket = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first of a bucket is its smallest
    low = (shingles[first] & np.uint64((1 << 56) - 1)).astype(np.float64) + 1
    mantissa, exponent = np.frexp(low)
    out, full = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[bucket[first]] = ((57 - exponent) << MANTISSA) | ((mantissa * 2 - 1) * 2**MANTISSA).astype(np.int64)
    full[bucket[first]] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = out[_ORDER[empty, full[_ORDER[empty]].argmax(1)]]
    return out


def estimate(equal: np.ndarray | float) -> np.ndarray | float:
    """Jaccard similarity from the share of equal registers, less what equals by accident."""
    return (equal - ACCIDENT) / (1 - ACCIDENT)


def similar(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def row_id() -> Column:
    """doc_id, or a hash of the text where there is none; `given` tells the two apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("without an id"), text_or_empty()))


def has_id() -> Column:
    return F.col("doc_id").isNotNull()


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """id, given, n_shingles, digest and registers of every row."""
    def rows(batch: pa.RecordBatch, shingle: Shingler) -> pa.RecordBatch:
        sets = [shingle(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({
            "id": batch.column(0), "given": batch.column(2), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            "registers": pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())})

    return map_batches(docs.select(row_id().alias("id"), "text", has_id().alias("given")), rows, "id long, given boolean, n_shingles long, digest binary, registers binary",
                       lambda: Shingler(words))


def _banded(sketches: DataFrame) -> DataFrame:
    """id, n_shingles, band: a hash of the band's number and registers, 51 rows for each class."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
        parts = regs[:, :BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
        for i in range(BAND):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
        ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        return pa.RecordBatch.from_pydict({"id": np.repeat(ids, BANDS), "n_shingles": np.repeat(n, BANDS), "band": h.ravel().view(np.int64)})

    return map_batches(sketches.select("id", "n_shingles", "registers"), rows, "id long, n_shingles long, band long")


def _with_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, registers, shingles of the rows whose id is among *ids*."""
    def rows(batch: pa.RecordBatch, shingle: Shingler) -> pa.RecordBatch:
        sets = [shingle(t) for t in batch.column(1).to_pylist()]
        filled = pa.array([len(s) > 0 for s in sets])
        sets = [s for s in sets if len(s)]
        return pa.RecordBatch.from_pydict({"id": batch.column(0).filter(filled), "registers": pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                                           "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    wanted = docs.select(row_id().alias("id"), "text").join(ids, "id", "left_semi")
    return map_batches(wanted, rows, "id long, registers binary, shingles binary", lambda: Shingler(words))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: estimate first, then the full sets."""
    least = percent / 100 - SLACK

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for ra, sa, rb, sb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            ok = estimate(np.mean(np.frombuffer(ra, np.uint16) == np.frombuffer(rb, np.uint16))) >= least
            if ok:
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                ok = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
            keep.append(bool(ok))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("shingles").alias("sb"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "sa", "rb", "sb"), rows, "a long, b long")


def _compare_blocks(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between two blocks, of rows in different components."""
    left, right = (x.rename(columns=lambda c: c[2:]) for x in (left, right))
    out = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if left.empty or right.empty:
        return out
    regs = [np.frombuffer(b"".join(x["registers"]), np.uint16).reshape(len(x), REGISTERS) for x in (left, right)]
    sets = [[np.frombuffer(s, np.uint64) for s in x["shingles"]] for x in (left, right)]
    n = [np.array([len(s) for s in x]) for x in sets]
    ids, comps = [x["id"].to_numpy() for x in (left, right)], [x["component"].to_numpy() for x in (left, right)]
    least, found = percent / 100 - SLACK, []
    flat = np.concatenate(sets[1])
    known, column = np.unique(flat, return_inverse=True)
    held = np.zeros((len(known), len(right)), np.uint8) if len(known) * len(right) <= DENSE else None  # who holds a shingle
    if held is not None:
        held[column, np.repeat(np.arange(len(right)), n[1])] = 1
    for i, (s, r) in enumerate(zip(sets[0], regs[0])):
        near = np.flatnonzero((comps[1] != comps[0][i]) & (100 * np.minimum(n[0][i], n[1]) >= percent * np.maximum(n[0][i], n[1])))
        if len(near):
            near = near[estimate((regs[1][near] == r).mean(1)) >= least]
        if not len(near):
            continue
        if held is not None:
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            inter = held[at[known[at] == s]].sum(0, dtype=np.int64)[near]
        else:  # long texts: one pair after the other, by the same rule
            inter = np.array([len(np.intersect1d(s, sets[1][j], assume_unique=True)) for j in near])
        found += [(ids[0][i], ids[1][j]) for j in near[similar(inter, n[0][i], n[1][near], percent)]]
    return pd.DataFrame(found, columns=["a", "b"]) if found else out


def _links_in_blocks(groups: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between rows of a group (rep, id) that are still in different components.

    A component of a block's size or more gets blocks of its own and the rest is dealt by component, so that pairs of
    blocks of one component are left out.
    """
    rows = groups.join(components, "id", "left").select("rep", "id", F.coalesce("component", "id").alias("component"))
    by_component = cut_lineage(rows.groupBy("rep", "component").agg(F.count(F.lit(1)).alias("_n")))
    spans = by_component.groupBy("rep").agg(F.count(F.lit(1)).alias("_parts"), F.sum(F.when(F.col("_n") < BLOCK, F.col("_n")).otherwise(0)).alias("_small"))
    open_groups = by_component.join(spans.where("_parts > 1"), "rep")
    big = F.col("_n") >= BLOCK
    where = cut_lineage(open_groups.select(
        "rep", "component", F.when(big, F.col("component")).alias("own"),
        F.ceil(F.when(big, F.col("_n")).otherwise(F.col("_small")) / F.lit(float(BLOCK))).cast("int").alias("blocks")))
    dealt = cut_lineage(rows.join(where, ["rep", "component"]).select(
        "rep", "id", "component", "own", F.pmod(F.xxhash64(F.coalesce("own", F.lit(0)), F.when(F.col("own").isNull(), F.col("component")).otherwise(F.col("id"))), "blocks").alias("no")))
    blocks = dealt.groupBy("rep", "own", "no").agg(F.lit(1).alias("_")).select("rep", "own", "no", F.xxhash64("rep", "own", "no").alias("block"))
    left, right = (blocks.select("rep", *[F.col(c).alias(f"{c}_{s}") for c in ("own", "no", "block")]) for s in "lr")
    couples = left.join(right, "rep").where((F.col("block_l") <= F.col("block_r")) & ~F.coalesce(F.col("own_l") == F.col("own_r"), F.lit(False)))
    couples = cut_lineage(couples.select("rep", "block_l", "block_r"))
    filled = dealt.select("rep", F.xxhash64("rep", "own", "no").alias("block"), "id", "component")
    sides = []
    for side in "lr":
        placed = filled.select("rep", F.col("block").alias(f"block_{side}"), "id", "component").join(couples, ["rep", f"block_{side}"])
        names = ["rep", "block_l", "block_r", "id", "component", "registers", "shingles"]
        renamed = placed.join(sets, "id").select(*[F.col(n).alias(f"{side}_{n}") for n in names])  # two sides of one table need names of their own
        sides.append(renamed.groupBy(*renamed.columns[:3]))
    ship_package(groups.sparkSession)
    return sides[0].cogroup(sides[1]).applyInPandas(lambda x, y: _compare_blocks(x, y, percent), "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every linked id.

    Each round takes the least label among neighbours and then the label of that label, so long chains shrink by
    half a round; it ends when no label changes.
    """
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        seen = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("_least"))
        nearer = labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("component").alias("_old"), F.least("component", "_least").alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("component").alias("_jump"))
        new = cut_lineage(nearer.join(jump, "_new", "left").select("id", "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("component")))
        if new.where("component <> _old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """id, given, n_shingles, component, component_given of every row of *docs*.

    id is doc_id if `given`, else made of the text; component is the smallest given id reachable, or the smallest of the others if none is given.
    """
    rows = cut_lineage(_sketched(docs, words))
    filled = rows.where("n_shingles > 0")
    least = [F.min(F.when(F.col("given") == given, F.col("id"))).alias(name) for given, name in ((True, "_given"), (False, "_made"))]
    classes = cut_lineage(filled.groupBy("digest").agg(F.min("id").alias("class"), *least))
    chosen = filled.alias("r").join(classes.alias("c"), (F.col("r.digest") == F.col("c.digest")) & (F.col("r.id") == F.col("c.class"))).select("r.id", "n_shingles", "registers")
    bands = _banded(chosen)
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    in_bands = cut_lineage(bands.join(shared, "band"))
    weight = in_bands.groupBy("id").agg(F.sum("_size").alias("_weight"))
    weighed = cut_lineage(in_bands.join(weight, "id"))
    first = cut_lineage(weighed.groupBy("band").agg(F.max(F.struct("_weight", F.bitwise_not("id").alias("_id"), "n_shingles")).alias("_top")).select(
        "band", F.bitwise_not("_top._id").alias("rep"), F.col("_top.n_shingles").alias("_n")))
    groups = cut_lineage(weighed.join(first, "band").groupBy("rep", "id").agg(F.min("n_shingles").alias("n"), F.min("_n").alias("_n")))
    sets = cut_lineage(_with_sets(docs, groups.select("id").distinct(), words))
    fits = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    links = cut_lineage(_verified(groups.where((F.col("rep") != F.col("id")) & fits).select(F.col("rep").alias("a"), F.col("id").alias("b")), sets, percent))
    more = cut_lineage(_links_in_blocks(groups.select("rep", "id"), connected(links), sets, percent))
    linked = connected(links.unionByName(more))
    of_class = cut_lineage(classes.join(linked, classes["class"] == linked["id"], "left").select("digest", "_given", "_made", F.coalesce("component", "class").alias("_label")))
    names = of_class.groupBy("_label").agg(F.min("_given").alias("_given"), F.min("_made").alias("_made"))
    named = of_class.select("digest", "_label").join(names, "_label").drop("_label")
    joined = rows.join(named, "digest", "left")
    own = F.col("n_shingles") == 0
    return joined.select("id", "given", "n_shingles", F.when(own, F.col("id")).otherwise(F.coalesce("_given", "_made")).alias("component"),
                         F.when(own, F.col("given")).otherwise(F.col("_given").isNotNull()).alias("component_given"))


def _kept() -> Column:
    return (F.col("given") == F.col("component_given")) & (F.col("id") == F.col("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (whether that is the row's own)."""
    return components(docs, words, percent).select(
        F.when(F.col("given"), F.col("id")).alias("doc_id"), "n_shingles", F.when(F.col("component_given"), F.col("component")).alias("component_id"), _kept().alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that name their component, with all their columns; of rows with one doc_id the first by text stays."""
    kept = components(docs, words, percent).where(_kept()).select("id", "given").distinct()
    rows = docs.select(F.struct("*").alias("_row"), row_id().alias("id"), has_id().alias("given"), text_or_empty().alias("_text")).join(kept, ["id", "given"], "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "given").orderBy("_text"))
    return rows.withColumn("_first", first).where("_first = 1").select("_row.*")
