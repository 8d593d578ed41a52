"""Views that give the bench tables the shapes the operators work on.

Every view is a projection or a join of whole tables, so work on it grows with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions.levels import mapped, string_array
from auditspark.operators.spans import LINES
from auditspark.session import cut_lineage, dealt, spread
from auditspark.sources.traces import with_times

CAPABILITIES = list(fv.CAPABILITY_PATTERNS)
INTEGRATIONS = list(fv.INTEGRATION_PATTERNS)
PROVIDERS = list(fv.PROVIDER_PATTERNS)
MODELS = ["gpt-4o-2024-08-06", "claude-sonnet-4-5", "gemini-2.5-pro"]
CUTOFF = "2024-01-16T00:00:00.000Z"
SEGMENT_INTENT = {
    "AUTOMOBILE": "recommend_only", "BUILDING": "human_approved", "FURNITURE": "bounded_autonomous",
    "HOUSEHOLD": "unrestricted_autonomous", "MACHINERY": "whatever",
}
SEGMENT_STATUS = {
    "AUTOMOBILE": "production", "BUILDING": "production", "FURNITURE": "staging", "HOUSEHOLD": "dev",
    "MACHINERY": "retired",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(string_array(values), (index + 1).cast("int"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "events"))


def spans_of(events: DataFrame) -> DataFrame:
    """Trace spans from ``events``, batch or stream: the agent is the user, the vocabulary comes from ``props``."""
    e = events.select(
        "event_id", "user_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    uid, k = F.col("user_id"), F.col("k")
    hint_only = k % 17 == 5
    start = F.col("ts").cast("timestamp")
    kind = (
        F.when(k % 19 == 3, "approval").when(k % 23 == 4, "delegation")
        .when(F.col("event_type").isin("purchase", "signup"), "action")
        .when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "view", "retrieval")
        .otherwise("llm_call"))
    approved = F.when(uid % 20 == 7, F.lit(True)).when(F.col("ts") >= F.lit(CUTOFF[:10]).cast("timestamp_ntz"), (k % 6 == 0)).otherwise(k % 3 == 0)
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return with_times(e.select(
        F.format_string("trace-%06d.jsonl", (F.col("event_id") / 1000).cast("long")).alias("trace_file"),
        (F.col("event_id") % 1000 + 2).alias("trace_line"),
        ((F.col("event_id") / 1000).cast("long") * LINES + F.col("event_id") % 1000 + 2).alias("ord"),
        F.concat(F.lit("t"), uid, F.lit("-"), F.dayofmonth("ts")).alias("trace_id"),
        F.concat(F.lit("s"), F.col("event_id")).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        kind.alias("kind"),
        F.when(~hint_only, F.concat(F.lit("a"), uid)).alias("agent_id"),
        F.struct(F.concat(F.lit("svc.c"), uid).alias("module"), F.lit("Run.step").alias("qualname")).alias("agent_hint"),
        F.date_format(start, fmt).alias("start_ts"),
        F.date_format(F.timestamp_micros(F.unix_micros(start) + F.col("k") * 1000), fmt).alias("end_ts"),
        F.when((F.col("event_type") == "error") & (k % 4 == uid % 4), "error").otherwise("ok").alias("status"),
        F.when(k == 50, "content").otherwise("redacted").alias("redaction"),
        pick(CAPABILITIES, k % 23).alias("capability"),
        pick(INTEGRATIONS, k % 11).alias("integration"),
        pick(PROVIDERS, k % 5).alias("provider"),
        F.when(uid % 3 == 0, F.lit(MODELS[0])).when(uid % 3 == 1, F.lit(MODELS[1])).otherwise(pick(MODELS, k % 3)).alias("model"),
        F.lit(None).cast("string").alias("tool"),
        F.when(F.col("event_type") == "purchase", F.struct(
            F.col("value").alias("amount"), F.when(k % 10 == 7, "EUR").otherwise("USD").alias("currency"))).alias("amount"),
        F.when(approved, F.concat(F.lit("s"), F.col("event_id") - 1)).alias("approval_span_id"),
        F.when(kind == "delegation", F.concat(F.lit("a"), uid)).alias("from_agent_id"),
        F.when(kind == "delegation", F.concat(F.lit("a"), (uid * 7 + k) % 1500)).alias("to_agent_id"),
        F.create_map(F.lit("event"), F.col("event_type"), F.lit("k"), k.cast("string")).alias("attrs"),
    ))


def locate(df: DataFrame, name: str) -> DataFrame:
    """The file, line and span_id that an ordinal stands for, by the arithmetic of spans_of()."""
    file, line = F.floor(F.col(name) / LINES).cast("long"), F.pmod(F.col(name), F.lit(LINES))
    return df.withColumns({"file": F.when(F.col(name).isNotNull(), F.format_string("trace-%06d.jsonl", file)), "line": line,
                           "span_id": F.concat(F.lit("s"), (file * 1000 + line - 2).cast("string"))}).drop(name)


def is_now() -> Column:
    """Whether a span lies in the current window, not in the baseline."""
    return F.col("start_at") >= F.to_timestamp(F.lit(CUTOFF))


def _chosen(values: list[str], key: Column, a: int, b: int, mod: int, below: int) -> Column:
    """The values whose position satisfies (key*a + position*b) % mod < below."""
    return F.array_compact(F.array(*[
        F.when((key * a + i * b) % mod < below, F.lit(v)) for i, v in enumerate(values)]))


@dataclass(frozen=True)
class Registry:
    """Agents, what was declared of some of them, and the agents' findings, all from one read of ``customer``."""

    agents: DataFrame
    declared: DataFrame

    @property
    def findings(self) -> DataFrame:
        return registry_findings(self.agents)

    @property
    def known(self) -> DataFrame:
        """The agents that spans are held against where unknown ids are the point: every tenth is missing."""
        return self.agents.where(F.substring("id", 2, 20).cast("long") % 10 != 9)


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    """Stored once: every customer is an agent; three of four are declared, so that undeclared ones exist."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    both = cut_lineage(dealt(customers, "c_custkey").select(
        F.struct(*_agent_columns()).alias("agent"), F.when(F.col("c_custkey") % 4 != 3, F.struct(*_declared_columns())).alias("declared")))
    return Registry(both.select("agent.*"), both.where(F.col("declared").isNotNull()).select("declared.*"))


def registry_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an agent of a registry."""
    return table(spark, sf_dir, "customer").select(*_agent_columns())


def _agent_columns() -> list[Column]:
    c = F.col("c_custkey")
    return [
        F.concat(F.lit("a"), c).alias("id"), F.concat(F.lit("agent_"), c).alias("name"),
        F.concat(F.lit("c"), c).alias("symbol"),
        F.concat(F.lit("svc/m"), c % 40, F.lit("/c"), c, F.lit(".py")).alias("path"),
        (c % 50 + 1).cast("int").alias("line"),
        pick(fv.CONFIDENCES, c % 3).alias("confidence"),
        F.when(c % 12 == 0, F.array(F.lit("mcp"))).otherwise(F.array(F.lit("langchain"))).alias("frameworks"),
        _chosen(CAPABILITIES, c, 31, 17, 5, 2).alias("capabilities"),
        _chosen(INTEGRATIONS, c, 13, 7, 9, 1).alias("integrations"),
        _chosen(PROVIDERS, c, 11, 5, 8, 1).alias("providers"),
        _chosen(list(fv.PERMISSION_PATTERNS), c, 3, 2, 7, 2).alias("permission_tags"),
        _chosen(list(fv.CONTROL_DIMENSIONS), c, 5, 3, 6, 2).alias("controls"),
        pick(["recommend_only", "human_approved", "bounded_autonomous", "unrestricted_autonomous", "indeterminate"], c % 5).alias("autonomy_level"),
        (c % 15 == 3).alias("has_bounding"),
    ]


def registry_findings(agents: DataFrame) -> DataFrame:
    """Findings of every registry agent: each rule at most twice per agent, by arithmetic on its key."""
    key = F.substring("id", 2, 20).cast("long")
    rules = [r for r in fv.RULES if not r.startswith(("DECL", "RT"))]
    picks = F.array_compact(F.array(*[
        F.when((key * 7 + i * 11) % 13 < 2, F.struct(
            F.lit(rule).alias("rule_id"), F.lit(i).alias("i"), F.lit(fv.RULES[rule][2]).alias("severity")))
        for i, rule in enumerate(rules)]))
    base = agents.select("id", "path", key.alias("key"), F.explode(picks).alias("p"))
    variant = (
        F.when(F.col("p.rule_id") == "AI002", pick(["exec", "sql", "markup"], F.col("key") % 3))
        .when(F.col("p.rule_id") == "AI005", pick(["floating-alias", "trust-remote-code", "insecure-endpoint"], F.col("key") % 3)))
    line = (F.col("key") % 90 + F.col("p.i") + 1).cast("int")
    return base.select(
        F.col("id").alias("agent_id"), "path", F.col("p.rule_id").alias("rule_id"),
        F.when(F.col("p.rule_id") == "SEC002", pick(["high", "critical"], F.col("key") % 2)).otherwise(F.col("p.severity")).alias("severity"),
        pick(fv.CONFIDENCES, (F.col("key") + F.col("p.i")) % 3).alias("confidence"),
        line.alias("line"), F.lit(1).alias("column"), variant.alias("variant"),
        ((F.col("key") + F.col("p.i")) % 11 == 0).alias("suppressed"),
        F.coalesce((variant == "exec") & (F.col("key") % 2 == 0), F.lit(False)).alias("gate_eligible"),
        F.substring(F.sha2(F.concat_ws(":", F.col("p.rule_id"), F.col("path"), line.cast("string")), 256), 1, 16).alias("fingerprint"),
    )


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw declarations of three customers in four; some values are outside the vocabularies on purpose."""
    return table(spark, sf_dir, "customer").where(F.col("c_custkey") % 4 != 3).select(*_declared_columns())


def _declared_columns() -> list[Column]:
    c, bal = F.col("c_custkey"), F.col("c_acctbal")
    currency = F.when(c % 10 == 7, "EUR").otherwise("USD")
    econ = F.when(bal > 0, F.struct(
        F.struct((bal / 100).alias("amount"), currency.alias("currency")).alias("max_per_action"),
        F.struct((bal / 20).alias("amount"), currency.alias("currency")).alias("daily_aggregate"),
        F.lit(None).cast("struct<amount:double,currency:string>").alias("worst_case_customer_loss")))
    return [
        F.concat(F.lit("a"), c).alias("agent_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("team-"), F.col("c_nationkey")).alias("owner"),
        F.when(c % 6 != 0, F.concat(F.lit("serves "), F.lower("c_mktsegment"))).alias("purpose"),
        pick(["internal", "customers", "public", "robots", "internal"], c % 5).alias("users"),
        F.when(c % 5 != 0, F.array(F.concat(F.lit("N"), F.col("c_nationkey")))).alias("geography"),
        mapped(F.col("c_mktsegment"), SEGMENT_STATUS).alias("production_status"),
        mapped(F.col("c_mktsegment"), SEGMENT_INTENT).alias("autonomy_intent"),
        _chosen(fv.DATA_CLASSES + ["secrets"], c, 3, 5, 4, 1).alias("data_classes"),
        econ.alias("economic_authority"),
    ]


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_file, trace_line, text): every event as a line of JSON, a header in front of most files.

    Some headers name a later major version, some files have none, some lines are cut in half and some are blank.
    """
    s = spans(spark, sf_dir)
    number = F.regexp_extract("trace_file", r"(\d+)", 1).cast("long")
    json = F.to_json(F.struct("kind", "trace_id", "span_id", "agent_id", "start_ts", "end_ts", "status", "redaction", "capability", "integration",
                              "provider", "model", F.struct(F.col("amount.amount").cast("double").alias("amount"), "amount.currency").alias("amount"), "approval_span_id"))
    k = F.col("attrs")["k"].cast("long")
    lines = s.withColumn("json", json).select(
        "trace_file", F.col("trace_line").cast("long").alias("trace_line"),
        F.when(k % 31 == 7, F.expr("substr(json, 1, length(json) div 2)")).when(k % 37 == 11, F.lit("  \t")).otherwise(F.concat(F.lit(" "), F.col("json"))).alias("text"))
    header = F.to_json(F.struct(
        F.lit("header").alias("kind"), F.when(number % 7 == 3, "spans/9.1").otherwise(f"spans/{fv.TRACE_MAJOR}.2").alias("schema"), (number % 4).alias("dropped_spans"),
        F.when(number % 5 == 0, "content").otherwise("redacted").alias("redaction")))
    heads = s.select("trace_file").distinct().where(number % 6 != 5).select("trace_file", F.lit(1).cast("long").alias("trace_line"), header.alias("text"))
    return lines.unionByName(heads)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, web pages and conversation turns as files to scan."""
    def of(name: str, path: Column, content: str, *keys: str) -> DataFrame:
        return spread(table(spark, sf_dir, name), *keys).select(
            F.concat(F.lit(name + "/"), path, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit(False).alias("is_testlike"),
            F.octet_length(F.coalesce(F.col(content), F.lit(""))).cast("long").alias("length"), F.coalesce(F.col(content), F.lit("")).alias("content"))

    return of("documents", F.col("doc_id").cast("string"), "text", "doc_id").unionByName(
        of("pages", F.col("page_id").cast("string"), "html", "page_id")).unionByName(
        of("conversations", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text", "conv_id", "turn"))
