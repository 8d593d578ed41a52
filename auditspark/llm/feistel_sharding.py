"""Shards by a pseudo-random permutation of global row numbers.

Rows are numbered 0..N-1 by a rule that depends on their content only, the number goes through a Feistel network on
Z_a x Z_b (a*b is N or slightly more) with cycle walking, and the permuted number p gives shard p mod S and slot p div S.
Nothing is shuffled but narrow keys, the same rows and seed give the same shards in any cluster, and a row's place
can be computed from its number alone.

Defined cases: null or empty text has size 1 and crc32 0; a null doc_id is a key like any other; fully repeated rows
take consecutive numbers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import text_or_empty
from auditspark.session import cut_lineage

#: Buckets in which rows are numbered. The offsets of the buckets are the only rows that meet in one task.
BUCKETS = 8192
ROUNDS = 6
#: More steps than any walk takes: each one leaves the range with a chance of about 1/sqrt(N), and small N have short cycles.
WALK = 64


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over Z_a x Z_b, a*b >= n: a bijection on 0..a*b-1."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    left, right = x % a, F.floor(x / F.lit(a)) if n > 2**53 else ((x - x % a) / a).cast("long")
    for i in range(ROUNDS):
        if i % 2:
            right = (right + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), left), F.lit(b))) % b
        else:
            left = (left + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), right), F.lit(a))) % a
    return right * a + left


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row number *x* in the permutation of 0..n-1: pass again while the result is outside."""
    first = feistel(x, n, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, seed)))
    place = F.when(first < n, first).otherwise(walked)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(keys: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """*keys* with a dense global `row` from 0, and their number.

    Equal keys are counted before the shuffle. Numbers run by bucket of the keys' hash, then by key, so no sort of all
    rows is needed and a bucket's rows stay within one task of ordinary size.
    """
    bucket = F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int").alias("_bucket")
    order = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in cols])
    counted = keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).select("*", bucket)
    local = cut_lineage(counted.withColumn("_end", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    sizes = local.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))  # at most BUCKETS rows
    first = F.col("_offset") + F.col("_end") - F.col("_n")
    rows = local.join(offsets, "_bucket").select(*cols, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("row"))
    return rows, total


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row; shard sizes differ by one row at most."""
    text = text_or_empty()
    keys = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(keys, ["doc_id", "size", "text_crc32"])
    placed = rows.withColumn("_p", permuted(F.col("row"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")
