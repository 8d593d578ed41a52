"""Contradictions between what was declared or scanned and what traces show (RT001-RT005)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.functions import text as X
from auditspark.functions.text import finding_fingerprint
from auditspark.operators import spans as S
from auditspark.settings import DEFAULT, Settings


def suppression(settings: Settings, rule: str, agent: Column) -> Column:
    """The first matching entry of the runtime suppression list, null when there is none."""
    reason = F.lit(None).cast("string")
    for entry in reversed(settings.runtime_suppress):
        name, _, target = entry.partition(":")
        if name == rule:
            reason = F.when(F.lit(target == "*") | (agent == target), F.lit(f"suppressed by runtime entry {entry}")).otherwise(reason)
    return reason


def subjects(agents: DataFrame, declared: DataFrame) -> DataFrame:
    """Registry agents beside what was declared of them; a join by id, for the two of them stored apart."""
    own = declared.select(F.col("agent_id").alias("id"), "autonomy_intent", "production_status", "economic_authority.max_per_action", "economic_authority.daily_aggregate")
    return agents.select("id", "path", "line", "autonomy_level", "capabilities").join(own, "id", "left")


def _observed(facts: S.Facts) -> DataFrame:
    """One row per agent: its summary, the first span of each capability of the vocabulary, and where its evidence lies."""
    vocabulary = (F.col("dim") == "capability") & F.col("value").isin(list(fv.CAPABILITY_PATTERNS))  # bounds the list
    one = facts.rows("span", "kind", "capability", "currency").groupBy("agent_id", "dim", "value").agg(
        *(F.sum(c).alias(c) for c in ("n", "errors", "high", "approved")), *(F.max(c).alias(c) for c in ("redacted", "content", "last_at", "max_amount", "largest")),
        *(F.min(c).alias(c) for c in ("first_at", "first", "first_unapproved")))
    high = (F.col("dim") == "capability") & L.is_high_impact(F.col("value"))
    return one.groupBy(F.col("agent_id").alias("id")).agg(
        *S.summary_columns(), F.min(F.when(F.col("dim") == "span", F.col("first_unapproved"))).alias("unapproved_at"),
        F.collect_list(F.when(vocabulary, F.struct(F.col("value").alias("capability"), F.col("first").alias("at")))).alias("seen"),
        F.min(F.when(high, F.struct("value", "first"))).alias("high_seen"),
        F.max(F.when(F.col("dim") == "currency", F.struct("largest", F.col("value").alias("currency"), "max_amount"))).alias("biggest"),
    ).withColumns(S.derived_columns())


def _hit(when: Column, rule: str, context: Column, confidence: str, at: Column | None, declared_key: str | None = None) -> Column:
    nothing = F.lit(None)
    return F.when(when, F.struct(
        F.lit(rule).alias("rule_id"), context.alias("snippet"), F.lit(confidence).alias("confidence"), (nothing if at is None else at).cast("long").alias("ord"),
        (nothing if declared_key is None else F.lit(declared_key)).cast("string").alias("key")))


def detect(subjects: DataFrame, facts: S.Facts, settings: Settings = DEFAULT, monitoring_declared: bool = True) -> DataFrame:
    """All runtime contradictions, in one pass over the agents beside their observed facts.

    ``subjects`` has id, path, line, capabilities, autonomy_level and the declared autonomy_intent, production_status,
    max_per_action and daily_aggregate. Spans are aggregated by agent before they meet it, so agents it
    does not know cost nothing but their share of the scan.
    """
    daily = F.coalesce(F.col("daily_aggregate.currency"), F.lit("USD"))
    totals = S.amount_totals(facts).select(F.col("agent_id").alias("id"), F.col("currency").alias("_daily"), "total")
    base = subjects.withColumn("_daily", daily).join(totals, ["id", "_daily"], "left").join(_observed(facts), "id", "left")
    seen, unapproved = F.col("span_count").isNotNull(), F.col("high_impact_actions") - F.col("high_impact_approved")
    place = F.lit(S.ORDINALS - 1) - F.pmod(F.col("biggest.largest"), F.lit(S.ORDINALS).cast("decimal(19,0)")).cast("long")
    hits = []
    if settings.on("RT001"):
        hits.append(F.array(_hit(
            seen & F.col("autonomy_intent").isin(fv.OVERSIGHT_INTENTS) & (unapproved > 0), "RT001",
            F.format_string("autonomy_intent='%s' vs %d unapproved high-impact action(s)", F.col("autonomy_intent"), unapproved), "high", F.col("unapproved_at"), "autonomy_intent")))
    if settings.on("RT002"):
        over = (F.col("biggest.currency") == F.col("max_per_action.currency")) & (F.col("biggest.max_amount") > F.col("max_per_action.amount"))
        hits.append(F.array(
            _hit(over, "RT002", F.concat(F.lit("observed "), X.amount_text(F.col("biggest.max_amount")), F.lit(" "), F.col("biggest.currency"),
                                         F.lit(" > declared max_per_action "), X.amount_text(F.col("max_per_action.amount"))), "high", place, "economic_authority.max_per_action"),
            _hit(F.col("total") > F.col("daily_aggregate.amount"), "RT002",
                 F.concat(F.lit("window total "), X.amount_text(F.col("total")), F.lit(" "), F.col("daily_aggregate.currency"),
                          F.lit(" > declared daily_aggregate "), X.amount_text(F.col("daily_aggregate.amount"))), "high", place, "economic_authority.daily_aggregate")))
    if settings.on("RT003"):
        beyond = F.filter("seen", lambda c: ~F.coalesce(F.array_contains(F.col("capabilities"), c["capability"]), F.lit(False)))
        hits.append(F.transform(beyond, lambda c: _hit(
            F.lit(True), "RT003", F.format_string("observed capability '%s' absent from static registry", c["capability"]), "medium", c["at"])))
    if settings.on("RT004") and monitoring_declared:
        hits.append(F.array(_hit((F.col("production_status") == "production") & ~seen, "RT004", F.lit("production + monitoring declared, zero spans observed"),
                                 "medium", None, "production_status")))
    if settings.on("RT005"):
        hits.append(F.array(_hit(
            (F.col("autonomy_level") == "human_approved") & (F.col("high_impact_actions") > 0) & (F.col("approval_rate") == 1.0), "RT005",
            F.format_string("approval observed on %1$d/%1$d high-impact action(s)", F.col("high_impact_actions")), "high", F.col("high_seen.first"))))
    none = F.array().cast("array<struct<rule_id:string,snippet:string,confidence:string,ord:bigint,key:string>>")
    found = base.select("id", "path", "line", F.explode(F.array_compact(F.concat(none, *(F.coalesce(h, none) for h in hits)))).alias("h")).select("id", "path", "line", "h.*")
    placed = _placed(facts, found)
    rule, reason = F.col("rule_id"), F.lit(None).cast("string")
    for name in sorted(r for r in fv.RULES if r.startswith("RT")):
        reason = F.when(rule == name, suppression(settings, name, F.col("id"))).otherwise(reason)
    of = lambda i: L.mapped(rule, {r: v[i] for r, v in fv.RULES.items()})
    return placed.withColumn("suppression_reason", reason).select(
        "rule_id", F.col("id").alias("agent_id"), "path", "line", of(0).alias("title"), of(1).alias("category"),
        L.mapped(rule, {r: settings.default_severity(r) for r in fv.RULES if r.startswith("RT")}).alias("severity"), "confidence", "snippet",
        finding_fingerprint(rule, F.col("path"), F.col("snippet")).alias("fingerprint"), F.col("suppression_reason").isNotNull().alias("suppressed"), "suppression_reason",
        "ref_file", "ref_line", "ref_span",
        F.when(F.col("key").isNotNull(), F.concat(F.lit('agents."'), F.col("id"), F.lit('".'), F.col("key"))).alias("declared_key"))


def _placed(facts: S.Facts, found: DataFrame) -> DataFrame:
    """Findings with ref_file, ref_line and ref_span."""
    return facts.refs(found.withColumnRenamed("line", "_own_line")).withColumnsRenamed(
        {"file": "ref_file", "line": "ref_line", "span_id": "ref_span", "_own_line": "line"})
