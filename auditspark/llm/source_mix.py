"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u)/w, u from a hash of the row and w its quality weight; within a source the
documents with the smallest keys come first. A source's budget in words is spent on complete epochs (every document
once) and then on the documents in key order until the running sum of sizes meets the rest.

Running sums over one source are built from key ranges, so that a source with a third of all rows spreads over many
tasks: 1 - exp(-key * scale) maps the keys of any source to (0, 1), and equal steps of it hold similar numbers of rows.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
a source whose documents hold no words has target 0; fully repeated rows share a key and are taken in any order; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import WORD, text_or_empty
from auditspark.session import cut_lineage

#: Key ranges of a source.
RANGES = 1024
#: No source is repeated more often than this.
MAX_EPOCHS = 3


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.5 and 1: how near the mean length of the words is to that of ordinary prose."""
    mean = (F.length(text) - size + 1) / F.greatest(size, F.lit(1))
    return F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0)


def targets(sizes: DataFrame, share: float = 1.0, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: weights 1, 2, 3 repeating by source, none above *cap* times its size.

    Sources reach their cap in order of cap per weight, so the level is the first at which what the others would get
    is below the next cap; this equals sharing the excess again and again. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", (1 + (F.row_number().over(by_name) - 1) % 3).cast("long")).withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = weighed.select(
        "*", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_left"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_weights"))
    level = F.min(F.when(F.col("_cap") * F.col("_weights") >= F.col("_left") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_left", "_weights"))).over(everything)
    ranked = ranked.withColumn("_level", level)
    fair = F.col("_w") * F.col("_level._left") / F.col("_level._weights")
    return ranked.select("source", "source_size", F.least(F.coalesce(fair, F.col("_cap").cast("double")), F.col("_cap").cast("double")).alias("target"))


def sized(docs: DataFrame, seed: int, *carry: Column) -> DataFrame:
    """doc_id, source, size, the exponential key of every document and the range it falls in."""
    text = text_or_empty()
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    token = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    u = (F.conv(F.substring(token, 1, 12), 16, 10).cast("long") + 1) / F.lit(float(2**48 + 1))
    keyed = docs.select("doc_id", "source", size.alias("size"), quality_weight(text, size).alias("_weight"), u.alias("_u"), *carry)
    keyed = keyed.withColumn("key", -F.log("_u") / F.col("_weight")).drop("_u", "_weight")
    return keyed.withColumn("_range", F.floor((1 - F.exp(-F.col("key") * 0.75)) * RANGES).cast("int"))


def range_plan(keyed: DataFrame) -> DataFrame:
    """source, _range -> words of the source before the range, and the source's size and target."""
    ranges = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    goals = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))  # RANGES + 1 rows a source at most
    return starts.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "s.source", "_range", "_before", "source_size", "target")


def taken_words(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """*keyed* with source_size, target and taken: complete epochs, then the documents in key order until the budget is met."""
    within = Window.partitionBy("source", "_range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    summed = keyed.withColumn("_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._range") == F.col("p._range"))
    joined = summed.alias("d").join(plan.alias("p"), same).select("d.*", "_before", "source_size", "target")
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    rest = F.round("target").cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_before") + F.col("_end") - F.col("size"))))
    return joined.withColumn("taken", (epochs * F.col("size") + part).cast("long"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, key.

    taken counts words; the document at the border gives what is left of the budget, so a source's sum is its target
    rounded to whole words.
    """
    keyed = cut_lineage(sized(docs, seed))  # narrow rows; the text is read once
    return taken_words(keyed, range_plan(keyed)).select("doc_id", "size", "source", "source_size", "target", "taken", "key")


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it; the one at the border if half of it is taken."""
    plan = range_plan(sized(docs, seed))
    whole = sized(docs, seed, F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    copies = F.expr("int((2 * taken + size) div (2 * greatest(size, 1)))")
    return taken_words(whole, plan).select("_row", F.explode(F.sequence(F.lit(0), copies)).alias("_i")).where("_i > 0").select("_row.*")
