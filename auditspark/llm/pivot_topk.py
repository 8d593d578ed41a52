"""Exact inner-product search by a pivot table.

With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0): then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so large
products are small distances. Distances of all vectors to PIVOTS of them are kept in a table; |d(q',p) - d(x',p)| bounds
d(q',x') from below for every pivot p, and the largest bound limits the product from above. A query's candidates are
evaluated in the order of that limit until the next one is under its k-th best score.

Vectors are packed into blocks of one nearest pivot; queries are packed likewise and first meet one block of their own
pivot, which gives each a score that its k best must reach. Then each block of the stated query set meets each block of
vectors; of a pair of blocks only candidates that reach the score come out.

Defined cases: rows whose id is null, or whose vector is null or holds a null or non-finite component, take no part; of
rows that share a vec_id the one with the smallest vector counts; shorter vectors are filled up with zeros; products beyond
64 bits become the nearest 64-bit number; fewer candidates than k give all of them; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import map_batches
from auditspark.session import cut_lineage, ship_package

PIVOTS = 32
#: Rows of a block of vectors, and of queries.
BLOCK, QUERIES = 1024, 256
#: Candidates evaluated before the first look at the bound; doubled each time.
STEP = 64
LONG = 2**63 - 1


def points(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components times *scale* rounded down."""
    raw = F.col("embedding")
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(raw, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    valid = vectors.where(F.col("vec_id").isNotNull() & raw.isNotNull()).where(~bad)
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    top = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, vectors)]
    most = top[0] * top[1] * max(1, queries.shape[1])
    if most < 2.0**52:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return queries @ vectors.T
    return np.clip(queries.astype(object) @ vectors.T.astype(object), -LONG - 1, LONG).astype(np.int64)


class Table:
    """What every task knows: dimension, largest norm, pivots (in the widened space)."""

    def __init__(self, dim: int, pivots: list[list[int]], most: float):
        self.dim, self.most = dim, most
        self.pivots = self.widened(np.array([p + [0] * (dim - len(p)) for p in pivots], np.int64).reshape(len(pivots), dim))

    def widened(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in self.pivots], 1)

    def rows(self, column: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.int64).reshape(len(column), self.dim)

    def limits(self, q: np.ndarray, to_query: np.ndarray, to_block: np.ndarray) -> np.ndarray:
        """No product of a query with a row of the block is above this; slack covers rounding."""
        low = np.zeros((len(q), len(to_block)))
        for p in range(to_block.shape[1]):
            np.maximum(low, np.abs(to_query[:, p, None] - to_block[None, :, p]), out=low)
        norm = (q.astype(np.float64) ** 2).sum(1)[:, None] + self.most
        return (norm - low * low) / 2 + 1e-9 * (norm + 1)

    def best(self, query_id: int, q: np.ndarray, limit: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best that reach *least*: candidates by limit, until the next limit is under the k-th."""
        order = np.argsort(-limit, kind="stable")
        got, scores, at, step, kth = [], [], 0, STEP, least
        while at < len(order) and limit[order[at]] >= kth:
            some = order[at:at + step]
            some = some[(limit[some] >= kth) & (ids[some] != query_id)]
            got.append(ids[some])
            scores.append(products(q[None], v[some])[0])
            at, step = at + step, 2 * step
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = max(least, float(np.partition(every, len(every) - k)[len(every) - k]))
        if not got:
            return []
        got, scores = np.concatenate(got), np.concatenate(scores)
        top = np.lexsort((got, -scores))[:k]
        return [(int(got[i]), int(scores[i])) for i in top if scores[i] >= least]


def _measured(known: DataFrame, table: Table) -> DataFrame:
    """vec_id, v (64-bit integers), cell (nearest pivot)."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = np.zeros((batch.num_rows, table.dim), np.int64)
        for i, x in enumerate(batch.column(1).to_pylist()):
            v[i, :len(x)] = x
        cell = table.distances(table.widened(v)).argmin(1).astype(np.int32)
        return pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "cell": pa.array(cell), "v": pa.array([x.tobytes() for x in v], pa.binary())})

    return map_batches(known.select("vec_id", "v"), rows, "vec_id long, cell int, v binary")


def _packed(rows: DataFrame, table: Table, size: int, query: bool) -> DataFrame:
    """One row for each block: cell, part, ids, vectors and their distances to the pivots."""
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each pivot at most
    if not sizes:
        parts = F.lit(1)
    else:
        parts = F.element_at(F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(n / size))]), F.col("cell"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        v = table.rows(list(pdf["v"]))
        wide = np.column_stack([v.astype(np.float64), np.zeros(len(v))]) if query else table.widened(v)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                             "vectors": [v.tobytes()], "distances": [table.distances(wide).tobytes()]})

    ship_package(rows.sparkSession)
    return dealt.groupBy("cell", "part").applyInPandas(pack, "cell int, part int, ids binary, vectors binary, distances binary")


def _opened(table: Table, ids: bytes, vectors: bytes, distances: bytes):
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.int64).reshape(len(i), table.dim), np.frombuffer(distances).reshape(len(i), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query among all other rows, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    known = cut_lineage(points(vectors))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    facts = known.agg(F.max(norm).alias("most"), F.max(F.size("v")).alias("dim")).first()
    pivots = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    table = Table(facts["dim"] or 0, [list(r["v"]) for r in pivots], facts["most"] or 0.0)
    if not pivots:
        return known.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    measured = cut_lineage(_measured(known, table))
    blocks = cut_lineage(_packed(measured, table, BLOCK, False))
    queries = _packed(measured.where(is_query), table, QUERIES, True)

    def first_look(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = []
        for ids, v, d, other in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), batch.select(["b_ids", "b_vectors", "b_distances"]).to_pylist()):
            i, q, to_query = _opened(table, ids, v, d)
            floor = np.full(len(i), -np.inf)
            if other["b_ids"] is not None:
                j, x, to_block = _opened(table, *other.values())
                limit = table.limits(q, to_query, to_block)
                for r in range(len(i)):
                    got = table.best(i[r], q[r], limit[r], j, x, k, -np.inf)
                    floor[r] = got[-1][1] if len(got) == k else -np.inf
            least.append(floor.tobytes())
        return pa.RecordBatch.from_arrays([batch.column(c) for c in range(4)] + [pa.array(least, pa.binary())], ["cell", "ids", "vectors", "distances", "least"])

    near = blocks.where("part = 0").select("cell", *[F.col(c).alias(f"b_{c}") for c in ("ids", "vectors", "distances")])
    met = queries.join(near, "cell", "left").select("cell", "ids", "vectors", "distances", "b_ids", "b_vectors", "b_distances")
    asked = cut_lineage(map_batches(met, first_look, "cell int, ids binary, vectors binary, distances binary, least binary"))

    def second_look(batch: pa.RecordBatch):
        out = []
        for pair in batch.to_pylist():
            i, q, to_query = _opened(table, pair["ids"], pair["vectors"], pair["distances"])
            j, x, to_block = _opened(table, pair["b_ids"], pair["b_vectors"], pair["b_distances"])
            least = np.frombuffer(pair["least"])
            limit = table.limits(q, to_query, to_block)
            for r in np.flatnonzero(limit.max(1) >= least):
                out += [(int(i[r]), *hit) for hit in table.best(i[r], q[r], limit[r], j, x, k, least[r])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["query_id", "vec_id", "score"])

    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))  # each block of queries to every slot
    dealt = blocks.select(F.pmod(F.xxhash64("cell", "part"), F.lit(slots)).cast("int").alias("slot"), *[F.col(c).alias(f"b_{c}") for c in ("ids", "vectors", "distances")])
    pairs = dealt.join(every, "slot").select("ids", "vectors", "distances", "least", "b_ids", "b_vectors", "b_distances")
    hits = map_batches(pairs, second_look, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
