"""Per-agent aggregation of spans.

One scan of the spans gives one long table of facts: a row for each agent (or, without one, hint), window, dimension and
value, with measures of fixed width that combine map-side. An agent with very many values, or a third of all spans, never becomes one big
row, and every rule re-aggregates the facts instead of reading spans again. "First" and "largest" evidence is
an ordinal of the span (file, then line) packed into one number, so it merges like a count; the span it
names is looked up at the end, for the few rows that are reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.session import cut_lineage

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
COUNTED = ["kind", "status", "capability", "integration", "provider", "model"]
DRIFT_FIELDS = ["kind", "capability", "integration"]
#: Lines of a file that an ordinal tells apart, and ordinals of all files.
LINES, ORDINALS = 1 << 31, 10**18


def iso(ts: Column) -> Column:
    """UTC text of an instant, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), TS_FORMAT)


def is_high_impact_action() -> Column:
    return F.coalesce(L.is_high_impact(F.col("capability")), F.lit(False)) & F.col("kind").isin("action", "tool_call")


def is_approved() -> Column:
    return F.coalesce(F.col("approval_span_id"), F.lit("")) != ""


def _filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(c != "", c)


# ---------------------------------------------------------------- one aggregate

Locate = Callable[[DataFrame, str], DataFrame]


def ordered(spans: DataFrame) -> DataFrame:
    """Spans with `ord`, their ordinal by file name and line; file names alone meet in one window."""
    files = spans.select("trace_file").distinct().withColumn("_file", F.row_number().over(Window.orderBy("trace_file")).cast("long"))
    return spans.join(files, "trace_file").withColumn("ord", F.col("_file") * LINES + F.col("trace_line")).drop("_file")


def located_in(spans: DataFrame) -> Locate:
    """Looks ordinals up in the spans themselves."""
    named = spans.select("ord", F.col("trace_file").alias("file"), F.col("trace_line").alias("line"), "span_id")
    return lambda df, name: df.join(named.withColumnRenamed("ord", name), name, "left").drop(name)


@dataclass(frozen=True)
class Facts:
    """agent_id, hint (null where there is an agent_id), is_now, dim, value and the measures.

    Dimensions: span (value ''), the fields of COUNTED, currency (of spans with an amount) and delegate (the target).
    """

    table: DataFrame
    located: Locate

    def stored(self) -> "Facts":
        """Computed once and kept, for more than one use."""
        return replace(self, table=cut_lineage(self.table))

    def given(self) -> "Facts":
        return replace(self, table=self.table.where(F.col("agent_id").isNotNull()))

    def window(self, now: bool) -> "Facts":
        return replace(self, table=self.table.where(F.col("is_now") == now))

    def rows(self, *dims: str) -> DataFrame:
        return self.table.where(F.col("dim").isin(*dims))

    def refs(self, df: DataFrame, name: str = "ord") -> DataFrame:
        """*df* with file, line and span_id in place of the ordinal."""
        return self.located(df, name)


def facts(spans: DataFrame, located: Locate | None = None, now: Column | None = None) -> Facts:
    """The facts of *spans*, which have `ord` if *located* is given; *now* tells the current window from the baseline."""
    if located is None:
        spans = ordered(spans)
        located = located_in(spans)
    hint = F.concat_ws(":", *(F.coalesce(_filled(F.col(f"agent_hint.{part}")), F.lit("unknown")) for part in ("module", "qualname")))
    agent, high = _filled(F.col("agent_id")), is_high_impact_action()
    amount, status = F.col("amount.amount"), F.coalesce(_filled(F.col("status")), F.lit("ok"))
    currency = F.when(amount.isNotNull(), F.coalesce(_filled(F.col("amount.currency")), F.lit("USD")))
    fields = {"span": F.lit(""), **{d: _filled(F.col(d)) for d in COUNTED}, "currency": currency,
              "delegate": F.when(F.col("kind") == "delegation", _filled(F.col("to_agent_id")))}
    # the amount to a millionth before the ordinal, which the earliest span wins
    scaled = F.greatest(F.lit(-1e13), F.least(F.lit(1e13), amount)).cast("decimal(20,6)").cast("decimal(26,6)") * F.lit(10**6).cast("decimal(7,0)")
    largest = scaled.cast("decimal(20,0)") * F.lit(ORDINALS).cast("decimal(19,0)") + (F.lit(ORDINALS - 1) - F.col("ord")).cast("decimal(19,0)")
    flat = spans.select(
        agent.alias("agent_id"), F.when(agent.isNull(), hint).alias("hint"), (F.lit(True) if now is None else now).alias("is_now"),
        (status == "error").alias("error"), high.alias("high"), (high & is_approved()).alias("approved"),
        (F.col("redaction") == "redacted").alias("redacted"), (F.col("redaction") == "content").alias("content"),
        "start_at", "end_at", amount.cast("double").alias("amount"), amount.cast("decimal(24,4)").alias("sum"), largest.alias("largest"), "ord",
        *(v.alias(f"d_{d}") for d, v in fields.items()))
    # all of that is computed once a span, below the generator
    measures = [c for c in flat.columns if not c.startswith("d_")]
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"d_{d}").alias("value")) for d in fields])
    flat = flat.select(*measures, F.inline(pairs)).where(F.col("value").isNotNull())
    return Facts(flat.groupBy("agent_id", "hint", "is_now", "dim", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"), F.count_if("high").alias("high"), F.count_if("approved").alias("approved"),
        F.max(F.col("redacted").cast("int")).alias("redacted"), F.max(F.col("content").cast("int")).alias("content"),
        F.min("start_at").alias("first_at"), F.max("end_at").alias("last_at"), F.max("amount").alias("max_amount"), F.sum("sum").alias("total"),
        F.max("largest").alias("largest"), F.min("ord").alias("first"), F.min(F.when(F.col("high") & ~F.col("approved"), F.col("ord"))).alias("first_unapproved"),
    ), located)


def summary_columns() -> list[Column]:
    """Aggregates over rows of the dimensions span and kind."""
    whole = F.col("dim") == "span"
    of = lambda name: F.when(whole, F.col(name))
    return [F.sum(of("n")).alias("span_count"), *(F.coalesce(F.sum(F.when((F.col("dim") == "kind") & (F.col("value") == k), F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in fv.SPAN_KINDS),
            F.sum(of("errors")).alias("errors"), F.sum(of("high")).alias("high_impact_actions"), F.sum(of("approved")).alias("high_impact_approved"),
            F.max(of("redacted")).alias("_redacted"), F.max(of("content")).alias("_content"), F.min(of("first_at")).alias("first_at"),
            F.max(of("last_at")).alias("last_at"), F.max(of("max_amount")).alias("max_amount")]


def derived_columns() -> dict[str, Column]:
    """Rates and the evidence quality, from the columns of summary_columns()."""
    mixed = (F.col("_redacted") == 1) & (F.col("_content") == 1)
    return {"error_rate": L.half_even(F.col("errors") / F.col("span_count"), 4),
            "approval_rate": F.when(F.col("high_impact_actions") > 0, L.half_even(F.col("high_impact_approved") / F.col("high_impact_actions"), 4)),
            "approval_spans": F.col("n_approval"),
            "evidence_quality": F.when(mixed, "mixed").when(F.col("_content") == 1, "content").otherwise("redacted")}


def summarize(f: Facts, *key: str) -> DataFrame:
    """One row per agent (or *key*) with every scalar of the summary."""
    return f.rows("span", "kind").groupBy(*(key or ("agent_id",))).agg(*summary_columns()).withColumns(derived_columns()).drop("_redacted", "_content")


def value_counts(f: Facts, dims: list[str] | None = None) -> DataFrame:
    """(agent_id, dim, value, n): kinds, statuses, capabilities, integrations, providers, models; distinct sets are its values."""
    return f.rows(*(dims or COUNTED)).groupBy("agent_id", "dim", "value").agg(F.sum("n").alias("n"))


def delegations(f: Facts) -> DataFrame:
    return f.rows("delegate").select("agent_id", F.col("value").alias("to_agent_id")).distinct()


def amount_totals(f: Facts) -> DataFrame:
    """(agent_id, currency, total): exact decimal sums, so addition order cannot matter."""
    return f.rows("currency").groupBy("agent_id", F.col("value").alias("currency")).agg(F.sum("total").cast("double").alias("total"))


def first_unapproved(f: Facts) -> DataFrame:
    """The first high-impact action without an approval, in file and line order."""
    first = f.rows("span").where(F.col("first_unapproved").isNotNull()).groupBy("agent_id").agg(F.min("first_unapproved").alias("ord"))
    return f.refs(first)


def first_capability_spans(f: Facts) -> DataFrame:
    return f.refs(f.rows("capability").groupBy("agent_id", F.col("value").alias("capability")).agg(F.min("first").alias("ord")))


def largest_amounts(f: Facts) -> DataFrame:
    """agent_id, amount, currency, ord: the largest amount whatever its currency; the earliest span wins a tie (of amounts to a millionth)."""
    best = f.rows("currency").groupBy("agent_id").agg(F.max(F.struct("largest", "value")).alias("b"), F.max("max_amount").alias("amount"))
    place = F.lit(ORDINALS - 1) - F.pmod(F.col("b.largest"), F.lit(ORDINALS).cast("decimal(19,0)")).cast("long")
    return best.select("agent_id", "amount", F.col("b.value").alias("currency"), place.alias("ord"))


def max_amount_spans(f: Facts) -> DataFrame:
    return f.refs(largest_amounts(f))


def window_totals(f: Facts) -> DataFrame:
    return f.rows("span").agg(F.min("first_at").alias("start_at"), F.max("last_at").alias("end_at"), F.coalesce(F.sum("n"), F.lit(0)).alias("span_count"))


# ---------------------------------------------------------------- correlation with a registry

def classify(f: Facts, registry_ids: DataFrame | None) -> Facts:
    """Facts with `bucket` (matched / unmatched), `key` and `reason`: every agent and hint is held against the registry once.

    ``registry_ids`` has one column ``id``; without it every given id counts as known.
    """
    subjects = f.rows("span").select("agent_id", "hint").distinct()
    if registry_ids is None:
        known = subjects.withColumn("_known", F.col("agent_id").isNotNull())
    else:
        ids = registry_ids.select(F.col("id").alias("agent_id")).distinct().withColumn("_known", F.lit(True))
        hints = subjects.where(F.col("agent_id").isNull()).withColumn("_known", F.lit(False))  # never meet the registry
        agents = subjects.where(F.col("agent_id").isNotNull()).join(ids, "agent_id", "left")
        known = agents.withColumn("_known", F.coalesce("_known", F.lit(False))).select(*hints.columns).unionByName(hints)
    given = F.col("agent_id").isNotNull()
    named = known.select(
        F.coalesce("agent_id", F.lit("")).alias("_agent"), F.coalesce("hint", F.lit("")).alias("_hint"),
        F.when(F.col("_known"), "matched").otherwise("unmatched").alias("bucket"),
        F.when(F.col("_known"), F.col("agent_id")).when(given, F.concat(F.lit("unknown-id:"), F.col("agent_id"))).otherwise(F.col("hint")).alias("key"),
        F.when(F.col("_known"), F.lit(None)).when(given, "agent_id not present in the registry").otherwise("no agent_id supplied (hint only)").alias("reason"))
    met = f.table.withColumns({"_agent": F.coalesce("agent_id", F.lit("")), "_hint": F.coalesce("hint", F.lit(""))}).join(named, ["_agent", "_hint"])
    return replace(f, table=met.drop("_agent", "_hint"))


def unmatched(classified: Facts) -> DataFrame:
    """key, reason and the whole summary of spans that no registry agent owns."""
    return summarize(replace(classified, table=classified.table.where(F.col("bucket") == "unmatched")), "key", "reason")


def suggested_matches(unmatched_keys: DataFrame, agents: DataFrame) -> DataFrame:
    """(key, agent_id, name, path): agents whose symbol or file stem occurs in the key.

    Tokens meet in an equi join: the module parts and the first part of the qualified name.
    """
    module, qualname = F.split_part("key", F.lit(":"), F.lit(1)), F.expr("substring(key, instr(key, ':') + 1)")
    tokens = F.array_distinct(F.concat(F.split(module, "\\."), F.array(F.split_part(qualname, F.lit("."), F.lit(1)))))
    needles = (
        unmatched_keys.select("key").distinct().select("key", F.explode(tokens).alias("token"))
        .where(~F.col("token").isin("", "unknown"))
    )
    base = F.substring_index("path", "/", -1)
    stem = F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    names = agents.select(
        F.col("id").alias("agent_id"), "name", "path",
        F.explode(F.array_distinct(F.array("symbol", stem))).alias("token"))
    return needles.join(names, "token").select("key", "agent_id", "name", "path").distinct()


def without_evidence(registry_ids: DataFrame, matched_agents: DataFrame) -> DataFrame:
    """Registry agents with no span in the window."""
    return registry_ids.select(F.col("id").alias("agent_id")).join(matched_agents.select("agent_id"), "agent_id", "left_anti")


def approvals_verified(spans: DataFrame) -> DataFrame:
    """High-impact actions with the approval span they name, and whether it came first."""
    actions = spans.where(is_high_impact_action() & is_approved()).select(
        "agent_id", "trace_id", "span_id", "start_at", F.col("approval_span_id").alias("_ref"))
    granted = spans.where(F.col("kind") == "approval").select(
        "trace_id", F.col("span_id").alias("_ref"), F.col("end_at").alias("granted_at"))
    return actions.join(granted, ["trace_id", "_ref"], "left").select(
        "agent_id", "trace_id", "span_id", F.col("_ref").alias("approval_span_id"),
        F.col("granted_at").isNotNull().alias("approval_exists"),
        F.coalesce(F.col("granted_at") <= F.col("start_at"), F.lit(False)).alias("approval_precedes"))
