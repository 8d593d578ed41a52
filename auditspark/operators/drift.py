"""Behavioural drift of agents against a baseline.

A baseline is two tables, written once and read back: per-agent scalars and per-agent value
counts. Every comparison is an equi join of already aggregated tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.operators import spans as S
from auditspark.settings import DEFAULT, Settings

BASELINE_SCHEMA = "runtime-baseline/1.0"


class BaselineVersionError(ValueError):
    """The stored baseline has another major version."""


@dataclass
class Behaviour:
    """Aggregates of one window of spans."""

    summary: DataFrame
    counts: DataFrame
    totals: DataFrame | None = None
    max_amounts: DataFrame | None = None

    @classmethod
    def of(cls, facts: S.Facts) -> "Behaviour":
        return cls(S.summarize(facts), S.value_counts(facts, dims=S.DRIFT_FIELDS), S.amount_totals(facts), S.largest_amounts(facts))


def write_baseline(behaviour: Behaviour, folder: str) -> None:
    """Distil a window into the committed baseline tables."""
    (behaviour.summary.select("agent_id", "span_count", "approval_rate", F.lit(BASELINE_SCHEMA).alias("schema"))
     .write.mode("overwrite").parquet(f"{folder}/summary"))
    behaviour.counts.write.mode("overwrite").parquet(f"{folder}/counts")
    for name, table in (("totals", behaviour.totals), ("max_amounts", behaviour.max_amounts)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")


def check_version(schema: str) -> None:
    def major(s):
        return s.rsplit("/", 1)[-1].split(".")[0] if "/" in s else ""

    if major(schema) != major(BASELINE_SCHEMA):
        raise BaselineVersionError(f"unsupported baseline schema {schema!r}")


def read_baseline(spark: SparkSession, folder: str) -> Behaviour:
    summary = spark.read.parquet(f"{folder}/summary")
    versions = summary.select("schema").distinct().take(2)
    for row in versions:
        check_version(row["schema"])
    return Behaviour(summary, *(spark.read.parquet(f"{folder}/{name}") for name in ("counts", "totals", "max_amounts")))


EVENT_COLUMNS = {
    "class": "string", "kind": "string", "agent_id": "string", "field": "string", "category": "string",
    "high_impact": "boolean", "rate_now": "double", "rate_baseline": "double", "ratio": "double",
    "count_now": "long", "observed": "double", "declared": "double", "currency": "string",
}


def _events(df: DataFrame, cls, kind, **detail) -> DataFrame:
    given = {"class": cls, "kind": kind, "agent_id": F.col("agent_id"), **detail}
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items()}
    return df.select(*[
        given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in EVENT_COLUMNS.items()])


def new_values(now: Behaviour, base: Behaviour, static_caps: DataFrame | None = None) -> DataFrame:
    """Capabilities and integrations seen now and not in the baseline.

    ``static_caps`` is (agent_id, capability); a high-impact capability known there is medium.
    """
    keys = ["agent_id", "dim", "value"]
    wanted = now.counts.where(F.col("dim").isin("capability", "integration")).select(*keys)
    new = wanted.join(base.counts.select(*keys), keys, "left_anti")
    if static_caps is not None:
        static = static_caps.select("agent_id", F.lit("capability").alias("dim"), F.col("capability").alias("value")).distinct()
        new = new.join(static.withColumn("_static", F.lit(True)), keys, "left")
    else:
        new = new.withColumn("_static", F.lit(None).cast("boolean"))
    high = (F.col("dim") == "capability") & L.is_high_impact(F.col("value"))
    escalates = high & F.col("_static").isNull()
    return _events(
        new, F.when(escalates, "high").otherwise("medium"),
        F.when(escalates, "new_high_impact_capability").when(F.col("dim") == "capability", "new_capability").otherwise("new_integration"),
        field=F.col("dim"), category=F.col("value"),
        high_impact=F.when(F.col("dim") == "capability", high))


def gone_capabilities(now: Behaviour, base: Behaviour) -> DataFrame:
    keys = ["agent_id", "dim", "value"]
    gone = base.counts.where(F.col("dim") == "capability").select(*keys).join(now.counts.select(*keys), keys, "left_anti")
    return _events(gone, "info", "capability_no_longer_observed", field="capability", category=F.col("value"))


def approval_drops(now: Behaviour, base: Behaviour, settings: Settings = DEFAULT) -> DataFrame:
    both = now.summary.select("agent_id", F.col("approval_rate").alias("r_now")).join(
        base.summary.select("agent_id", F.col("approval_rate").alias("r_base")), "agent_id")
    drop = both.where(F.col("r_base") - F.col("r_now") >= F.lit(float(settings.approval_drop)))
    return _events(drop, "high", "approval_rate_drop", rate_now=F.col("r_now"), rate_baseline=F.col("r_base"))


def frequency_shifts(now: Behaviour, base: Behaviour, settings: Settings = DEFAULT) -> DataFrame:
    """Categories whose share of the agent's spans moved by the ratio threshold, either way."""
    keys = ["agent_id", "dim", "value"]
    b = base.counts.join(base.summary.select("agent_id", F.col("span_count").alias("base_total")), "agent_id").select(
        *keys, F.col("n").alias("n_base"), "base_total")
    n = now.counts.where(F.col("n") >= settings.min_count) if settings.min_count > 0 else now.counts
    n = n.select(*keys, F.col("n").alias("n_now"))
    # a category absent now can only qualify when a count of zero is enough
    joined = b.join(n, keys, "inner" if settings.min_count > 0 else "left")
    joined = joined.join(now.summary.select("agent_id", F.col("span_count").alias("now_total")), "agent_id",
                         "inner" if settings.min_count > 0 else "left")
    n_now = F.coalesce(F.col("n_now"), F.lit(0))
    rate_now = F.when(F.col("now_total") > 0, n_now / F.col("now_total")).otherwise(F.lit(0.0))
    rate_base = F.when(F.col("base_total") > 0, F.col("n_base") / F.col("base_total")).otherwise(F.lit(0.0))
    rated = joined.select(*keys, n_now.alias("n_now"), rate_now.alias("rn"), rate_base.alias("rb")).where(F.col("rb") != 0)
    ratio = F.col("rn") / F.col("rb")
    threshold = float(settings.ratio_threshold)
    shifted = rated.where(F.col("dim").isin(S.DRIFT_FIELDS) & ((ratio >= threshold) | (ratio <= 1.0 / threshold)))
    return _events(
        shifted, "medium", "frequency_shift", field=F.col("dim"), category=F.col("value"),
        rate_now=L.half_even(F.col("rn"), 4), rate_baseline=L.half_even(F.col("rb"), 4),
        ratio=L.half_even(ratio, 2), count_now=F.col("n_now"))


def amount_breaches(now: Behaviour, declared: DataFrame) -> DataFrame:
    """Observed amounts above the declared limits. The single-action check ignores currency."""
    econ = declared.select("agent_id", "economic_authority.max_per_action", "economic_authority.daily_aggregate")
    single = now.max_amounts.join(econ, "agent_id").where(F.col("amount") > F.col("max_per_action.amount"))
    daily = now.totals.join(econ, "agent_id").where(
        (F.col("currency") == F.coalesce("daily_aggregate.currency", F.lit("USD")))
        & (F.col("total") > F.col("daily_aggregate.amount")))
    return _events(
        single, "high", "amount_exceeds_declared_max_per_action", observed=F.col("amount"),
        declared=F.col("max_per_action.amount"), currency=F.col("currency"),
    ).unionByName(_events(
        daily, "high", "window_total_exceeds_declared_daily_aggregate", observed=F.col("total"),
        declared=F.col("daily_aggregate.amount"), currency=F.col("currency")))


def compute_drift(now: Behaviour, base: Behaviour, static_caps: DataFrame | None = None,
                  declared: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    parts = [new_values(now, base, static_caps), approval_drops(now, base, settings)]
    if declared is not None:
        parts.append(amount_breaches(now, declared))
    parts += [frequency_shifts(now, base, settings), gone_capabilities(now, base)]
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    return events


def summarize_events(events: DataFrame) -> DataFrame:
    """One row: counts by class and the worst class ("none" without events)."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in reversed(fv.DRIFT_LEVELS)],
        F.max(L.rank(F.col("class"), fv.DRIFT_LEVELS)).alias("_worst"),
    ).select("events", *[f"n_{c}" for c in reversed(fv.DRIFT_LEVELS)],
             F.coalesce(L.level(F.col("_worst"), fv.DRIFT_LEVELS), F.lit("none")).alias("max_class"))


def drift_gate(events: DataFrame, fail_on: str) -> bool:
    """True when any event reaches the level; stops at the first one."""
    reached = fv.DRIFT_LEVELS[fv.DRIFT_LEVELS.index(fail_on):] if fail_on in fv.DRIFT_LEVELS else []
    return bool(reached) and not events.where(F.col("class").isin(reached)).isEmpty()
