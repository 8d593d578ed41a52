"""Risk-dimension scoring of agents, its rollup, and the re-bucketing from traces."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.settings import DEFAULT, Settings


class TaxonomyMismatch(ValueError):
    """Two registries were scored with different taxonomies."""


@dataclass(frozen=True)
class Taxonomy:
    """Scoring data; replaceable as a whole."""

    id: str = "default-8"
    version: str = fv.TAXONOMY_VERSION
    dimensions: list = field(default_factory=lambda: list(fv.DIMENSIONS))
    finding_weights: dict = field(default_factory=lambda: dict(fv.FINDING_WEIGHTS))
    confidence_multipliers: dict = field(default_factory=lambda: dict(fv.CONFIDENCE_MULTIPLIERS))
    capability_weight: float = fv.CAPABILITY_WEIGHT
    provider_weight: float = fv.PROVIDER_WEIGHT
    control_credit: float = fv.CONTROL_CREDIT
    rule_dimensions: dict = field(default_factory=lambda: dict(fv.RULE_DIMENSIONS))
    capability_dimensions: dict = field(default_factory=lambda: dict(fv.CAPABILITY_DIMENSIONS))
    control_dimensions: dict = field(default_factory=lambda: dict(fv.CONTROL_DIMENSIONS))

    def __post_init__(self):
        if not self.id or not self.version or not self.dimensions:
            raise ValueError("a taxonomy needs an id, a version and dimensions")


DEFAULT_TAXONOMY = Taxonomy()


def _lists(key: Column, table: dict) -> Column:
    return L.mapped(key, {k: list(v) for k, v in table.items()}, [])


def dimensions_of(rule: Column, variant: Column, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """The dimensions a finding counts for; some rules go by variant."""
    by_variant = L.mapped(F.concat_ws("/", rule, variant), {f"{r}/{v}": list(d) for (r, v), d in fv.VARIANT_DIMENSIONS.items()})
    return F.coalesce(by_variant, _lists(rule, taxonomy.rule_dimensions))


def tag_findings(findings: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    return findings.withColumn("dimensions", F.array_sort(dimensions_of(F.col("rule_id"), F.col("variant"), taxonomy)))


def unclassified(findings: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Unsuppressed findings that no dimension takes, so that nothing is lost."""
    return tag_findings(findings.where(~F.col("suppressed")), taxonomy).where(F.size("dimensions") == 0)


def contributions(agents: DataFrame, findings: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """(agent_id, dimension, source, points): everything that moves a score, in exact decimals."""
    points = "decimal(18,4)"
    weight = L.mapped(F.col("severity"), taxonomy.finding_weights, 0).cast("decimal(9,2)")
    factor = L.mapped(F.col("confidence"), {k: str(v) for k, v in taxonomy.confidence_multipliers.items()}, "1.0").cast("decimal(4,2)")
    from_findings = (
        findings.where(~F.col("suppressed"))
        .select("agent_id", F.explode(dimensions_of(F.col("rule_id"), F.col("variant"), taxonomy)).alias("dimension"),
                F.lit("finding").alias("source"), (weight * factor).cast(points).alias("points")))
    from_caps = (
        agents.select(F.col("id").alias("agent_id"), F.explode("capabilities").alias("cap"))
        .select("agent_id", F.explode(_lists(F.col("cap"), taxonomy.capability_dimensions)).alias("dimension"),
                F.lit("capability").alias("source"), F.lit(taxonomy.capability_weight).cast(points).alias("points")))
    from_providers = (
        agents.where(F.size("providers") > 0)
        .select(F.col("id").alias("agent_id"), F.lit("dependency-drift").alias("dimension"), F.lit("capability").alias("source"),
                F.lit(taxonomy.provider_weight).cast(points).alias("points")))
    from_controls = (
        agents.select(F.col("id").alias("agent_id"), F.explode("controls").alias("control"))
        .select("agent_id", F.explode(_lists(F.col("control"), taxonomy.control_dimensions)).alias("dimension"),
                F.lit("control").alias("source"), F.lit(-taxonomy.control_credit).cast(points).alias("points")))
    return from_findings.unionByName(from_caps).unionByName(from_providers).unionByName(from_controls)


def bucket(score: Column) -> Column:
    return (F.when(score <= 0, "none-observed").when(score < fv.BUCKET_LOW, "low")
            .when(score < fv.BUCKET_MODERATE, "moderate").otherwise("elevated"))


def statement(tier: Column, exposure: Column, n_find: Column, n_cap: Column, n_ctrl: Column) -> Column:
    """A one-line reading of an entry, from its numbers only."""
    counts = F.format_string("%d finding(s) and %d capability signal(s)", n_find, n_cap)
    return (
        F.when((tier == "proxy") & (exposure == "none-observed"), F.lit("proxy only: nothing adverse seen in configuration"))
        .when(tier == "proxy", F.concat(F.lit("proxy only: "), counts))
        .when((exposure == "none-observed") & (n_ctrl > 0), F.format_string("no exposure seen; %d control(s) observed", n_ctrl))
        .when(exposure == "none-observed", F.lit("no exposure seen"))
        .otherwise(F.concat(counts, F.format_string("; %d mitigating control(s)", n_ctrl))))


def assess(agents: DataFrame, findings: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """One row per agent and dimension.

    The contributions are summed once by (agent, dimension); agents without any get their zero
    rows from an explode of the constant dimension list, not from a product of tables.
    """
    scored = contributions(agents, findings, taxonomy).groupBy("agent_id", "dimension").agg(
        F.sum("points").alias("raw"),
        F.count_if(F.col("source") == "finding").alias("n_find"),
        F.count_if(F.col("source") == "capability").alias("n_cap"),
        F.count_if(F.col("source") == "control").alias("n_ctrl"))
    dims = F.array(*[
        F.struct(F.lit(i).alias("dimension"), F.lit(tier).alias("assessability"), F.lit(group).alias("group"))
        for i, tier, group in taxonomy.dimensions])
    grid = agents.select(F.col("id").alias("agent_id"), F.explode(dims).alias("d")).select("agent_id", "d.*")
    joined = grid.join(scored, ["agent_id", "dimension"], "left")
    score = F.greatest(F.lit(0), F.least(F.lit(100), L.half_even(F.coalesce("raw", F.lit(0).cast("decimal(18,4)")), 0).cast("int")))
    rows = joined.select(
        "agent_id", "dimension", "group", "assessability", score.alias("score"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_find", "n_cap", "n_ctrl")])
    raw = bucket(F.col("score"))
    exposure = (F.when(F.col("assessability") == "runtime-required", "not-assessable")
                .when((F.col("assessability") == "proxy") & (raw == "elevated"), "moderate").otherwise(raw))
    rows = rows.withColumn("exposure", exposure)
    return rows.withColumn("statement", statement(
        F.col("assessability"), F.col("exposure"), F.col("n_find"), F.col("n_cap"), F.col("n_ctrl")))


def rollup(assessment: DataFrame) -> DataFrame:
    """Per dimension: the worst exposure, agents elevated and moderate. Runtime entries mark the row."""
    worst = F.max(L.rank(F.col("exposure"), fv.EXPOSURES))
    return assessment.groupBy("dimension", "group").agg(
        L.level(worst, fv.EXPOSURES).alias("max_exposure"),
        F.count_if(F.col("exposure") == "elevated").alias("agents_elevated"),
        F.count_if(F.col("exposure") == "moderate").alias("agents_moderate"),
        F.max((F.col("assessability") == "runtime").cast("int")).alias("_runtime"),
        F.min(F.when(F.col("assessability") != "runtime", F.col("assessability"))).alias("_tier"),
    ).select(
        "dimension", "group", F.when(F.col("_runtime") == 1, "runtime").otherwise(F.col("_tier")).alias("assessability"),
        "max_exposure", "agents_elevated", "agents_moderate")


def group_rollup(assessment: DataFrame) -> DataFrame:
    """The same counts per group, per dimension and overall, from one aggregation."""
    return assessment.rollup("group", "dimension").agg(
        L.level(F.max(L.rank(F.col("exposure"), fv.EXPOSURES)), fv.EXPOSURES).alias("max_exposure"),
        F.count_if(F.col("exposure") == "elevated").alias("agents_elevated"),
        F.count_if(F.col("exposure") == "moderate").alias("agents_moderate"),
        F.grouping_id().cast("int").alias("level"))


def check_same_taxonomy(base: DataFrame, head: DataFrame) -> None:
    """Both tables carry a ``taxonomy`` struct; different values cannot be compared."""
    def only(df):
        rows = df.where(F.col("taxonomy").isNotNull()).select("taxonomy.id", "taxonomy.version").distinct().take(2)
        return [tuple(r) for r in rows]

    b, h = only(base), only(head)
    if b and h and b != h:
        raise TaxonomyMismatch(f"base taxonomy {b} differs from head taxonomy {h}")


# ---------------------------------------------------------------------- from traces

def model_stats(counts: DataFrame) -> DataFrame:
    """(agent_id, models, all_dated) from the value counts of spans."""
    distinct = counts.where(F.col("dim") == "model").select("agent_id", "value").distinct()
    dated = F.col("value").rlike(fv.DATED_SNAPSHOT)
    return distinct.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("models"), F.min(dated.cast("int")).alias("all_dated"))


def overlay_runtime(assessment: DataFrame, summary: DataFrame, models: DataFrame, declared: DataFrame,
                    settings: Settings = DEFAULT) -> DataFrame:
    """Proxy entries of two dimensions take their exposure from the observed window."""
    seen = (
        summary.where(F.col("first_at").isNotNull() & F.col("last_at").isNotNull() & (F.col("span_count") > 0))
        .select("agent_id", "span_count", "error_rate", "approval_rate", "first_at", "last_at")
        .join(models, "agent_id", "left")
        .join(declared.select("agent_id", "autonomy_intent"), "agent_id", "left"))
    n = F.coalesce("models", F.lit(0))
    drift = F.when(n > 1, "elevated").when((n == 1) & (F.col("all_dated") == 0), "moderate").otherwise("low")
    contradicted = F.coalesce(F.col("autonomy_intent").isin(fv.OVERSIGHT_INTENTS) & (F.col("approval_rate") < 1.0), F.lit(False))
    rate = F.coalesce("error_rate", F.lit(0.0))
    conduct = (F.when((rate >= settings.error_rate_elevated) | contradicted, "elevated")
               .when(rate >= settings.error_rate_moderate, "moderate").otherwise("low"))
    seen = seen.select("agent_id", "span_count", "first_at", "last_at", drift.alias("_drift"), conduct.alias("_conduct"),
                       F.lit(True).alias("_seen"))
    joined = assessment.join(seen, "agent_id", "left")
    applies = (F.coalesce("_seen", F.lit(False)) & F.col("dimension").isin(fv.UPGRADEABLE_DIMENSIONS)
               & (F.col("assessability") == "proxy"))
    observed = F.when(F.col("dimension") == "dependency-drift", F.col("_drift")).otherwise(F.col("_conduct"))
    keep = [c for c in assessment.columns if c not in ("assessability", "exposure")]
    return joined.select(
        *keep, F.when(applies, "runtime").otherwise(F.col("assessability")).alias("assessability"),
        F.when(applies, observed).otherwise(F.col("exposure")).alias("exposure"),
        F.when(applies, F.col("first_at")).alias("window_start"), F.when(applies, F.col("last_at")).alias("window_end"),
        F.when(applies, F.col("span_count")).alias("window_spans"))
