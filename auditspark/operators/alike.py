"""Sets that are alike, by number.

Two sets can reach a threshold only when they share one of their first n - ceil(t*n) + 1 hashes in rarest-first order. Hashes that
few sets have bring these together in a join. Where sets meet through a hash that many have, most pairs have to be looked at,
and a join would write each of them many times: such sets meet block by block, and a pair leaves a task only when it counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark.session import cut_lineage, ship_package, stored

#: Pairs that one hash may bring together in a join.
MEET = 1024
#: Sets in a block, hashes compared at a time and pairs held before only the wanted ones are kept.
BLOCK, HASHES, HELD = 1024, 4096, 1 << 20
#: Parts of the other side: a task holds one of them.
PARTS = 4
ALL = (1 << 62) - 1
NUMBERS = "b long, h long, jaccard double"


def hashes_of(hashes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(hashes)))


@dataclass(frozen=True)
class Sets:
    """The different sets of two sides by number, and who has which."""

    agents: DataFrame    # side, id, no
    known: DataFrame     # side, no, first (smallest id), set; numbers follow the order of first
    ordered: DataFrame   # side, no, o: numbers of the set's hashes, rarest first

    def texts(self, side: str, number: str, name: str) -> DataFrame:
        return self.known.where(F.col("side") == side).select(F.col("no").alias(number), F.array_join("set", "|").alias(name))


def numbered(base: DataFrame, head: DataFrame) -> Sets:
    """Sets of (id, hashes) rows; rows without hashes have none."""
    one = lambda df, side: df.where(F.size("hashes") > 0).select(F.lit(side).alias("side"), "id", hashes_of(F.col("hashes")).alias("set"))
    # a set's key: no two lists of hashes are written alike
    written = F.array_join(F.transform("set", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")
    rows = one(base, "b").unionByName(one(head, "h")).withColumn("key", F.unhex(F.sha2(written, 256)))
    known = stored(rows.groupBy("side", "key").agg(F.min("id").alias("first"), F.first("set").alias("set")).orderBy("first", "side", "key").withColumn(
        "no", F.monotonically_increasing_id()))
    tokens = known.select("side", "no", F.explode("set").alias("token"))
    order = cut_lineage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).orderBy("freq", "token").select(
        "token", F.monotonically_increasing_id().alias("t")))
    ordered = stored(tokens.join(order, "token").groupBy("side", "no").agg(F.array_sort(F.collect_list("t")).alias("o")))
    return Sets(rows.select("side", "id", "key").join(known.select("side", "key", "no"), ["side", "key"]).drop("key"), known.drop("key"), ordered)


def _starts(ordered: DataFrame, threshold: float) -> DataFrame:
    """(side, no, n, left, t, like): the first hashes of every set, what is left from there on and the class of its size."""
    n = F.size("o")
    keep = (n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)) + 1).cast("int")
    # sizes within the threshold of each other lie in one class or in two neighbouring ones
    width = math.log(1 / threshold) + 1e-6 if 0 < threshold < 1 else 1e-6
    like = F.floor(F.log(F.col("n").cast("double")) / width) if threshold > 0 else F.lit(0).cast("long")
    return ordered.select("side", "no", n.alias("n"), F.posexplode(F.slice("o", F.lit(1), keep)).alias("at", "t")).select(
        "side", "no", "n", (F.col("n") - F.col("at")).alias("left"), "t", like.alias("like"))


@dataclass(frozen=True)
class Alike:
    """Sets of both sides that reach a threshold: met through rare hashes, and those still to meet block by block."""

    few: DataFrame      # b, h, jaccard
    crowd: DataFrame    # side, no, o
    threshold: float

    def pairs(self, bases: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
        """(b, h, jaccard) by number.

        ``bases`` has (b, low, want): the ``want`` most similar, smallest number on a tie, whose ``by`` is above ``low``. ``heads`` has
        (h, no, by): several may share one set. Without them all sets stand for themselves.
        """
        of = lambda side, name: self.crowd.where(F.col("side") == side).select(F.col("no").alias(name), "o")
        if bases is None:
            left = of("b", "b").select("b", "o", F.lit(-1).cast("long").alias("low"), F.lit(ALL).alias("want"))
            met = self.few
        else:
            left = of("b", "b").join(bases, "b").select("b", "o", "low", "want")
            met = self.few.join(bases, "b")
        if heads is None:
            right = of("h", "h").select("h", "o", F.lit(ALL).alias("by"))
        else:
            right = of("h", "no").join(heads, "no").select("h", "o", "by")
            met = met.withColumnRenamed("h", "no").join(heads, "no").where(F.col("by") > F.col("low"))
        both = _met(left, right, self.threshold).unionByName(met.select("b", "h", "jaccard")).distinct()
        if bases is None:
            return both
        rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("jaccard"), "h"))
        return both.join(bases.select("b", "want"), "b").withColumn("_r", rank).where(F.col("_r") <= F.col("want")).select("b", "h", "jaccard")


def alike(ordered: DataFrame, threshold: float) -> Alike:
    starts = _starts(ordered, threshold)
    side = lambda s: F.count_if(F.col("side") == s)
    many = cut_lineage(starts.groupBy("t").agg((side("b") * side("h")).alias("pairs")).where(F.col("pairs") > MEET).select("t"))
    prefix = starts.join(many, "t", "left_anti")
    of = lambda side, number, size, rest, classes: prefix.where(F.col("side") == side).select(
        F.col("no").alias(number), F.col("n").alias(size), F.col("left").alias(rest), "t", classes.alias("like"))
    close = F.least("nb", "nh") >= F.lit(threshold) * F.greatest("nb", "nh") - F.lit(1e-9)
    needed = F.lit(threshold / (1 + threshold)) * (F.col("nb") + F.col("nh")) - F.lit(1e-9)
    near = F.explode(F.array(F.col("like") - 1, F.col("like"), F.col("like") + 1))
    pairs = of("b", "b", "nb", "rest_b", F.col("like")).join(of("h", "h", "nh", "rest_h", near), ["t", "like"]).where(
        close & (F.least("rest_b", "rest_h") >= needed)).select("b", "h").distinct()
    sets = lambda number, name, side: ordered.where(F.col("side") == side).select(F.col("no").alias(number), F.col("o").alias(name))
    common = F.size(F.array_intersect("ob", "oh"))
    few = pairs.join(sets("b", "ob", "b"), "b").join(sets("h", "oh", "h"), "h").select(
        "b", "h", (common / (F.size("ob") + F.size("oh") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    crowd = stored(ordered.join(starts.join(many, "t", "left_semi").select("side", "no").distinct(), ["side", "no"], "left_semi"))
    return Alike(few, crowd, threshold)


# ------------------------------------------------------------------ blocks

PACKED = "numbers binary, sizes binary, hashes binary, at binary, width int, marks binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sets: their numbers, sizes, different hashes and, set after set, the places of these; marks as they are."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            lists, marks = part.column(1), [np.asarray(part.column(c)).astype(np.int64) for c in range(2, part.num_columns)]
            hashes, at = np.unique(np.asarray(lists.flatten()).astype(np.int64), return_inverse=True)
            kind = np.min_scalar_type(len(hashes))
            yield pa.RecordBatch.from_pydict({
                "numbers": pa.array([np.asarray(part.column(0)).astype(np.int64).tobytes()], pa.binary()),
                "sizes": pa.array([np.asarray(pc.list_value_length(lists)).astype(np.int32).tobytes()], pa.binary()),
                "hashes": pa.array([hashes.tobytes()], pa.binary()), "at": pa.array([at.ravel().astype(kind).tobytes()], pa.binary()),
                "width": pa.array([kind.itemsize], pa.int32()), "marks": pa.array([b"".join(m.tobytes() for m in marks)], pa.binary())})


class _Block:
    """A block of sets as it is compared."""

    def __init__(self, numbers: bytes, sizes: bytes, hashes: bytes, at: bytes, width: int, marks: bytes):
        self.numbers, self.sizes, self.hashes = np.frombuffer(numbers, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(hashes, np.int64)
        self.at, self.row = np.frombuffer(at, f"u{width}"), np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.marks = np.frombuffer(marks, np.int64).reshape(-1, len(self.numbers))

    def grid(self, common: np.ndarray, first: int) -> np.ndarray:
        """Sets by some of the hashes that both blocks have: one where a set has the hash."""
        some = common[first:first + HASHES]
        place = np.full(len(self.hashes), -1)
        place[np.searchsorted(self.hashes, some)] = np.arange(len(some))
        column = place[self.at]
        out = np.zeros((len(self.sizes), len(some)), np.float32)
        out[self.row[column >= 0], column[column >= 0]] = 1
        return out


def _compare(b: _Block, h: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both blocks and likeness of all pairs that reach the threshold and whose ``by`` is above ``low``."""
    near = min(b.sizes.max(), h.sizes.max()) >= threshold * max(b.sizes.min(), h.sizes.min()) - 1e-9
    common = np.intersect1d(b.hashes, h.hashes, assume_unique=True)
    if not near or not len(common):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    shared = sum(b.grid(common, i) @ h.grid(common, i).T for i in range(0, len(common), HASHES)).astype(np.float64)
    jaccard = shared / (b.sizes[:, None] + h.sizes[None, :] - shared)
    i, j = np.nonzero((jaccard >= threshold) & (shared > 0) & (h.marks[0][None, :] > b.marks[0][:, None]))
    return i, j, jaccard[i, j]


def _wanted(want: np.ndarray, i: np.ndarray, h: np.ndarray, jaccard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most similar of each set, as many as it wants."""
    if not len(i) or np.bincount(i).max() <= want.min():
        return i, h, jaccard
    order = np.lexsort((h, -jaccard, i))
    i, h, jaccard = i[order], h[order], jaccard[order]
    begins = np.searchsorted(i, i, side="left")
    kept = np.arange(len(i)) - begins < want[i]
    return i[kept], h[kept], jaccard[kept]


def _meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks in, pairs of sets out. All blocks of the other side follow each other, so a set's best are chosen as they pass."""
    key, left, found, size = None, None, [], 0

    def rows(some) -> Iterator[pa.RecordBatch]:
        i, h, jaccard = some
        for at in range(0, len(i), HELD):
            part = slice(at, at + HELD)
            yield pa.RecordBatch.from_arrays([pa.array(left.numbers[i[part]]), pa.array(h[part]), pa.array(jaccard[part])], ["b", "h", "jaccard"])

    for batch in batches:
        for pair in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            mine, other = ([pair[f"{side}_{c.split()[0]}"] for c in PACKED.split(", ")] for side in "bh")
            if mine[0] != key:
                if found:
                    yield from rows(_wanted(left.marks[1], *map(np.concatenate, zip(*found))))
                key, left, found, size = mine[0], _Block(*mine), [], 0
            right = _Block(*other)
            i, j, jaccard = _compare(left, right, threshold)
            if len(i):
                found.append(_wanted(left.marks[1], i, right.numbers[j], jaccard))
                size += len(found[-1][0])
            if size > HELD:
                kept = _wanted(left.marks[1], *map(np.concatenate, zip(*found)))
                if left.marks[1].max() == ALL:  # all pairs are wanted
                    yield from rows(kept)
                    kept = None
                found, size = [kept] if kept else [], 0
    if found:
        yield from rows(_wanted(left.marks[1], *map(np.concatenate, zip(*found))))


def _met(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(b, h, jaccard) of sets (b, o, low, want) and (h, o, by): blocks of one side pass by those of the other, nothing is written for a pair."""
    spark = left.sparkSession
    ship_package(spark)

    def packed(df: DataFrame, parts: int, side: str) -> DataFrame:
        rows = df.repartition(parts, df.columns[0]).sortWithinPartitions(F.size("o"), df.columns[0])
        blocks = cut_lineage(rows.mapInArrow(_pack, PACKED))  # small: a byte or two for each hash of a set
        return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns])

    cores = spark.sparkContext.defaultParallelism
    pairs = packed(left, max(PARTS, cores), "b").crossJoin(packed(right, PARTS, "h").hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(lambda batches: _meet(batches, threshold), NUMBERS)
