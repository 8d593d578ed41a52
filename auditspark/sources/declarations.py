"""Declared facts, approvals, registries and rule switches as tables, with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.schemas import APPROVALS, DECLARED, EVIDENCE_REFS, REGISTRY
from auditspark.settings import Settings


def read_declared(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(DECLARED).format(fmt).load(path)


def _invalid_enum(col: str, allowed: list[str]) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).isin(allowed)


ENUMS = {"users": fv.USERS_VALUES, "production_status": fv.PRODUCTION_STATUSES, "autonomy_intent": fv.AUTONOMY_INTENTS}
LIMITS = ["max_per_action", "daily_aggregate", "worst_case_customer_loss"]


def _complete(limit: Column) -> Column:
    return limit["amount"].isNotNull() & limit["currency"].isNotNull()


def valid_declared(raw: DataFrame) -> DataFrame:
    """Values outside their vocabulary become null or leave the list; incomplete limits go."""
    econ = F.col("economic_authority")
    limits = {n: F.when(_complete(econ[n]), econ[n]) for n in LIMITS}
    any_limit = None
    for n in LIMITS:
        ok = F.coalesce(_complete(econ[n]), F.lit(False))
        any_limit = ok if any_limit is None else any_limit | ok
    return raw.withColumns({
        **{c: F.when(F.col(c).isin(allowed), F.col(c)) for c, allowed in ENUMS.items()},
        "data_classes": F.filter(F.coalesce("data_classes", F.array().cast("array<string>")),
                                 lambda x: x.isin(fv.DATA_CLASSES)),
        "economic_authority": F.when(any_limit, F.struct(*[v.alias(n) for n, v in limits.items()])),
    })


def declared_warnings(raw: DataFrame) -> DataFrame:
    """(agent_id, field, value): one row per rejected value."""
    econ = F.col("economic_authority")
    rows = [
        F.when(_invalid_enum(c, allowed), F.array(F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))))
        for c, allowed in ENUMS.items()
    ]
    rows.append(F.transform(
        F.filter(F.coalesce("data_classes", F.array().cast("array<string>")), lambda x: ~x.isin(fv.DATA_CLASSES)),
        lambda x: F.struct(F.lit("data_classes").alias("field"), x.alias("value"))))
    rows += [
        F.when(econ[n].isNotNull() & ~_complete(econ[n]),
               F.array(F.struct(F.lit(f"economic_authority.{n}").alias("field"), F.lit(None).cast("string").alias("value"))))
        for n in LIMITS
    ]
    empty = F.array().cast("array<struct<field:string,value:string>>")
    return raw.select("agent_id", F.explode(F.flatten(F.array(*[F.coalesce(r, empty) for r in rows]))).alias("w")).select(
        "agent_id", "w.field", "w.value")


def read_evidence(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Evidence pointers; entries without kind or reference are dropped."""
    raw = spark.read.schema(EVIDENCE_REFS).format(fmt).load(path)
    return raw.where(F.col("kind").isNotNull() & F.col("ref").isNotNull())


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(APPROVALS).parquet(path)


def append_approval(approvals: DataFrame, path: str) -> None:
    """Append approval records; rows must name a known kind."""
    known = F.when(F.col("kind").isin(fv.APPROVAL_KINDS), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown approval kind "), F.col("kind"))))
    approvals.withColumn("kind", known).select(*[f.name for f in APPROVALS]).write.mode("append").parquet(path)


def is_expired(as_of: str) -> Column:
    """A bad or missing date never expires."""
    return F.coalesce(F.to_date(F.try_to_timestamp("expires", F.lit("yyyy-MM-dd"))) < F.to_date(F.lit(as_of)), F.lit(False))


def list_approvals(approvals: DataFrame, as_of: str) -> DataFrame:
    return approvals.select("*", F.when(is_expired(as_of), "expired").otherwise("active").alias("state"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).option("multiLine", True).json(path)


def registry_tables(doc: DataFrame) -> dict[str, DataFrame]:
    """A nested registry document as flat tables."""
    agents = doc.select(F.explode("agents").alias("a")).select("a.*")
    return {
        "agents": agents.select(
            "id", "name", "symbol", "path", "language", "confidence", "detection_score", "evidence", "providers",
            "frameworks", "integrations", "capabilities", "permission_tags", "call_sites", "highest_severity",
            F.coalesce(F.get("evidence", F.lit(0))["line"], F.lit(1)).alias("line"),
            F.col("autonomy_level.level").alias("autonomy_level"),
            F.coalesce(F.exists("autonomy_level.signals", lambda s: s["signal"] == "bounding"), F.lit(False)).alias("has_bounding"),
            "declared"),
        "findings": agents.select(F.col("id").alias("agent_id"), F.explode("findings").alias("f")).select("agent_id", "f.*"),
        "dimensions": agents.select(F.col("id").alias("agent_id"), F.explode("dimension_assessment.dimensions").alias("d"),
                                    F.col("dimension_assessment.taxonomy").alias("taxonomy"))
        .select("agent_id", F.col("d.id").alias("dimension"), "d.group", "d.assessability", "d.exposure", "d.score", "taxonomy"),
        "repository_findings": doc.select(F.explode("repository_findings").alias("f")).select("f.*"),
    }


def rules_table(spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """The effective rules: switches and severity overrides applied. One row per known rule."""
    rows = [
        (rule, title, category, settings.default_severity(rule), gateable or rule in settings.gate_additional_rules, settings.on(rule))
        for rule, (title, category, _severity, gateable) in fv.RULES.items()
    ]
    return spark.createDataFrame(rows, "rule_id string, title string, category string, severity string, gateable boolean, enabled boolean")


def apply_rules(findings: DataFrame, rules: DataFrame, keep_given: bool = True) -> DataFrame:
    """Drops disabled rules and settles the severity of findings from any feed.

    ``keep_given`` keeps a severity the detector set; otherwise the rule table decides when it
    differs from the default.
    """
    # the rule table is a constant of this library: a few dozen rows
    known = F.broadcast(rules.where("enabled").select("rule_id", F.col("severity").alias("_rule_severity")))
    joined = findings.join(known, "rule_id")
    severity = F.coalesce("severity", "_rule_severity") if keep_given else F.coalesce("_rule_severity", "severity")
    return joined.withColumn("severity", severity).drop("_rule_severity")


def unknown_rules(named: DataFrame, rules: DataFrame) -> DataFrame:
    """Configured rule ids that do not exist; must be empty."""
    return named.select("rule_id").join(rules.select("rule_id"), "rule_id", "left_anti").distinct()


def read_taxonomy(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A replacement taxonomy: five small tables; one without dimensions or version is refused."""
    names = ["meta", "dimensions", "rule_dimensions", "capability_dimensions", "control_dimensions"]
    tables = {n: spark.read.json(f"{folder}/{n}.json") for n in names}
    meta = tables["meta"].take(1)
    if not meta or not meta[0]["id"] or not meta[0]["version"] or tables["dimensions"].isEmpty():
        raise ValueError(f"taxonomy in {folder} needs an id, a version and dimensions")
    return tables


def in_vocabulary(kind: str) -> Column:
    table = {"capability": fv.CAPABILITY_PATTERNS, "integration": fv.INTEGRATION_PATTERNS, "provider": fv.PROVIDER_PATTERNS}[kind]
    return F.col(kind).isin(list(table))


def severity_ok() -> Column:
    return L.severity_rank(F.col("severity")).isNotNull()
