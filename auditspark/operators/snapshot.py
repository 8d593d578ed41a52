"""Differences between two registry snapshots.

Set differences are taken on exploded rows: both snapshots are unioned with a side flag and
aggregated once by key, which needs one shuffle and combines map-side.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark import fixed_values as fv
from auditspark.functions import levels as L
from auditspark.functions.tables import union
from auditspark.operators import alike
from auditspark.session import cut_lineage, stored
from auditspark.sources.declarations import is_expired

ITEM_KINDS = {"capability": fv.HIGH_IMPACT_CAPABILITIES, "integration": fv.SENSITIVE_INTEGRATIONS}


def evidence_hashes(evidence: Column) -> Column:
    """Line-independent hashes of an agent's evidence entries."""
    return F.array_sort(F.array_distinct(F.transform(
        evidence, lambda e: F.substring(F.sha2(F.concat_ws(":", e["rule_id"], e["description"]), 256), 1, 12))))


def evidence_fingerprint(hashes: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(hashes), "|"), 256), 1, 12)


def sides(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``in_base`` and ``in_head``; each key once."""
    flag = lambda df, b, h: df.select(*keys, F.lit(b).alias("in_base"), F.lit(h).alias("in_head"))
    return flag(base, 1, 0).unionByName(flag(head, 0, 1)).groupBy(*keys).agg(
        F.max("in_base").alias("in_base"), F.max("in_head").alias("in_head"))


def with_head_ids(base: DataFrame, renamed: DataFrame, key: str = "id") -> DataFrame:
    """Base rows of renamed agents under their head id; ``renamed`` has base_id and head_id."""
    ids = renamed.select(F.col("base_id").alias(key), F.col("head_id").alias("_head"))
    return base.join(ids, key, "left").withColumn(key, F.coalesce("_head", key)).drop("_head")


def match_agents(base: DataFrame, head: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """(id, status): common, added or removed; a renamed agent is common under its head id."""
    base = base if renamed is None else with_head_ids(base.select("id"), renamed)
    return sides(base, head, ["id"]).select("id", F.when(F.col("in_base") + F.col("in_head") == 2, "common")
                                            .when(F.col("in_head") == 1, "added").otherwise("removed").alias("status"))


# ------------------------------------------------------------------------ renames

def similar_signatures(base: DataFrame, head: DataFrame, threshold: float = fv.RENAME_THRESHOLD) -> DataFrame:
    """(base_sig, head_sig, jaccard) of distinct evidence sets at or above the threshold.

    Inputs have (id, hashes). Agents with equal evidence share one signature, so a large group of copies is one row here. Candidates
    meet on the rare end of their sets only (see :mod:`alike`), so a hash that everybody has creates no pairs while rarer ones are
    there. In the join sets also have to be of like size, so they meet within classes of sizes: one of its own or a neighbouring
    class. The places of a shared hash bound what two sets can still share from there on; the first hash they share keeps every pair
    that reaches the threshold. Sets and hashes go by number: only pairs that reach the threshold meet the texts.
    """
    sets = alike.numbered(base, head)
    pairs = alike.alike(sets.ordered, threshold).pairs()
    return pairs.join(sets.texts("b", "b", "base_sig"), "b").join(sets.texts("h", "h", "head_sig"), "h").select("base_sig", "head_sig", "jaccard")


def best_candidates(base: DataFrame, head: DataFrame, threshold: float = fv.RENAME_THRESHOLD) -> DataFrame:
    """(base_id, head_id, jaccard): the most similar head of every base, smallest id on a tie.

    Every head signature stands in with its smallest id, so copies cost nothing. Signatures are numbered in the order of that id.
    """
    sets = alike.numbered(base, head)
    of = lambda side: F.col("side") == side
    wants = sets.known.where(of("b")).select(F.col("no").alias("b"), F.lit(-1).cast("long").alias("low"), F.lit(1).cast("long").alias("want"))
    best = alike.alike(sets.ordered, threshold).pairs(wants).join(
        sets.known.where(of("h")).select(F.col("no").alias("h"), F.col("first").alias("head_id")), "h")
    return sets.agents.where(of("b")).select(F.col("id").alias("base_id"), F.col("no").alias("b")).join(best, "b").select("base_id", "head_id", "jaccard")


#: Heads that a group of bases gets besides one for each of them, before its list is looked up again.
SPARE = 32


def renames(base_only: DataFrame, head_only: DataFrame, threshold: float = fv.RENAME_THRESHOLD) -> DataFrame:
    """(base_id, head_id, jaccard): one-to-one renames, base ids choosing in ascending order.

    Choosing one after the other equals proposals in which every head prefers the smallest base id: a waiting base
    proposes to its best head that no smaller id holds, heads keep the smallest id, and what is pushed out waits again. A
    round is joins and minima over all waiting bases. Bases of equal evidence propose in one round as well: of the
    heads that all of them may have, the i-th base takes the i-th, for the earlier ones keep those from it in any case.

    Everything goes by number, ids in their order. Not all pairs are kept: a group has a list of the best heads that its smallest waiting base may
    have. What is not on it is worse or held by a smaller base, which stays so; when lists hold nothing more for those
    that wait they are looked up again. A base smaller than those its group's list was made for waits for that. Lists and holders
    are stored as files, as a checkpoint keeps the estimated size of its joins, which would multiply from round to round.
    """
    sets = alike.numbered(base_only, head_only)
    order = cut_lineage(sets.agents.select("side", "id").distinct().orderBy("side", "id").withColumn("a", F.monotonically_increasing_id()))
    agents = cut_lineage(sets.agents.alias("x").join(order.alias("y"), (F.col("x.side") == F.col("y.side")) & F.col("x.id").eqNullSafe(F.col("y.id"))).select(
        "x.side", "no", "a"))
    bases = agents.where(F.col("side") == "b").select(F.col("no").alias("b"), "a")
    heads = agents.where(F.col("side") == "h").select(F.col("a").alias("h"), "no").distinct()
    close = alike.alike(sets.ordered, threshold)
    close = replace(close, few=cut_lineage(close.few))
    in_order = Window.partitionBy("b").orderBy("a")
    by_preference = Window.partitionBy("b").orderBy(F.desc("jaccard"), "h")
    held = heads.where(F.lit(False)).select("h", F.col("h").alias("a"), F.lit(0.0).alias("jaccard"))
    lists = held.select(F.col("a").alias("b"), "h", "jaccard", F.col("a").alias("low"))

    def waiting():
        return bases.join(held.select("a"), "a", "left_anti")

    while True:
        groups = cut_lineage(waiting().groupBy("b").agg(F.min("a").alias("low"), (F.count(F.lit(1)) + SPARE).alias("want")))
        free = heads.join(held.select("h", F.col("a").alias("by")), "h", "left").select("h", "no", F.coalesce("by", F.lit(alike.ALL)).alias("by"))
        fresh = close.pairs(groups, free).join(groups.select("b", "low"), "b")
        lists = stored(lists.join(groups, "b", "left_anti").select("b", "h", "jaccard", "low").unionByName(fresh.select("b", "h", "jaccard", "low")))
        new = 0
        while True:
            left = waiting().withColumn("i", F.row_number().over(in_order))
            ranges = left.groupBy("b").agg(F.min("a").alias("_low"), F.max("a").alias("_high"))
            options = (
                lists.join(ranges, "b").where(F.col("_low") >= F.col("low")).join(held.select("h", F.col("a").alias("_by")), "h", "left")
                .where(F.col("_by").isNull() | (F.col("_by") > F.col("_low"))).withColumn("i", F.row_number().over(by_preference))
                .withColumn("_disputed", F.min(F.when(F.col("_by") <= F.col("_high"), F.col("i"))).over(Window.partitionBy("b"))))
            asked = left.join(options, ["b", "i"]).where(
                F.col("_disputed").isNull() | (F.col("i") < F.col("_disputed")) | ((F.col("i") == F.col("_disputed")) & (F.col("_by") > F.col("a"))))
            proposals = cut_lineage(asked.select("h", "a", "jaccard"))
            if proposals.isEmpty():
                break
            new += 1
            best = F.min(F.struct("a", "jaccard")).alias("b")
            held = stored(held.unionByName(proposals).groupBy("h").agg(best).select("h", "b.a", "b.jaccard"))
        if not new:
            named = lambda side, number, name: order.where(F.col("side") == side).select(F.col("a").alias(number), F.col("id").alias(name))
            return held.join(named("b", "a", "base_id"), "a").join(named("h", "h", "head_id"), "h").select("base_id", "head_id", "jaccard")


# ------------------------------------------------------------------------ changes

def item_changes(base_items: DataFrame, head_items: DataFrame, common: DataFrame) -> DataFrame:
    """(agent_id, kind, value, change, flagged, drift) of agents in both snapshots.

    Items are (agent_id, kind, value); base items of a renamed agent carry its head id.
    """
    keys = ["agent_id", "kind", "value"]
    delta = sides(base_items, head_items, keys).where(F.col("in_base") != F.col("in_head"))
    delta = delta.join(common.select(F.col("id").alias("agent_id")), "agent_id", "left_semi")
    flagged = F.lit(False)
    for kind, values in ITEM_KINDS.items():
        flagged = F.when(F.col("kind") == kind, F.col("value").isin(values)).otherwise(flagged)
    added = F.col("in_head") == 1
    return delta.select(
        *keys, F.when(added, "added").otherwise("removed").alias("change"), flagged.alias("flagged"),
        F.when(~added, "info").when(flagged, "high").otherwise("medium").alias("drift"))


def finding_changes(base: DataFrame, head: DataFrame, common: DataFrame) -> DataFrame:
    """(agent_id, fingerprint, rule_id, severity, line, change); runtime findings do not count."""
    cols = ["agent_id", "fingerprint"]
    tag = lambda df, b, h: df.where(~F.col("rule_id").startswith("RT")).select(
        *cols, "rule_id", "severity", "line", F.lit(b).alias("in_base"), F.lit(h).alias("in_head"))
    both = tag(base, 1, 0).unionByName(tag(head, 0, 1)).groupBy(*cols, "rule_id", "severity", "line").agg(
        F.max("in_base").alias("in_base"), F.max("in_head").alias("in_head"))
    per_key = both.groupBy(*cols).agg(
        F.max("in_base").alias("in_base"), F.max("in_head").alias("in_head"),
        F.min(F.struct("line", "rule_id", "severity")).alias("f"))
    return per_key.where(F.col("in_base") != F.col("in_head")).join(
        common.select(F.col("id").alias("agent_id")), "agent_id", "left_semi").select(
        *cols, "f.rule_id", "f.severity", "f.line", F.when(F.col("in_head") == 1, "new").otherwise("resolved").alias("change"))


def dimension_changes(base: DataFrame, head: DataFrame, common: DataFrame) -> DataFrame:
    """(agent_id, dimension, from, to, direction); entries assessed from traces are left out."""
    keys = ["agent_id", "dimension"]
    cols = lambda df, b: df.select(
        *keys, L.rank(F.col("exposure"), fv.EXPOSURES).alias("rank"), (F.col("assessability") == "runtime").cast("int").alias("rt"), F.lit(b).alias("is_base"))
    both = cols(base, 1).unionByName(cols(head, 0)).groupBy(*keys).agg(
        F.max("rt").alias("rt"),
        F.coalesce(F.max(F.when(F.col("is_base") == 1, F.col("rank"))), F.lit(0)).alias("b"),
        F.coalesce(F.max(F.when(F.col("is_base") == 0, F.col("rank"))), F.lit(0)).alias("h"))
    return both.where((F.col("rt") == 0) & (F.col("b") != F.col("h"))).join(
        common.select(F.col("id").alias("agent_id")), "agent_id", "left_semi").select(
        *keys, L.level(F.col("b"), fv.EXPOSURES).alias("from"), L.level(F.col("h"), fv.EXPOSURES).alias("to"),
        F.when(F.col("h") > F.col("b"), "increased").otherwise("decreased").alias("direction"))


def added_agents(head: DataFrame, matched: DataFrame) -> DataFrame:
    """New agents with their drift and its reason; ``head`` has id, name, path, capabilities, integrations."""
    new = head.join(matched.where(F.col("status") == "added").select("id"), "id", "left_semi")
    high = F.array_sort(F.array_intersect("capabilities", L.string_array(fv.HIGH_IMPACT_CAPABILITIES)))
    sensitive = F.arrays_overlap("integrations", L.string_array(fv.SENSITIVE_INTEGRATIONS))
    return new.select(
        F.col("id").alias("agent_id"), "name", "path",
        F.when((F.size(high) > 0) | sensitive, "high").otherwise("medium").alias("drift"),
        F.when(F.size(high) > 0, F.concat(F.lit("new agent binds high-impact capability "), F.get(high, F.lit(0))))
        .when(sensitive, "new agent binds a sensitive integration").otherwise("new agent").alias("reason"))


def removed_agents(base: DataFrame, matched: DataFrame) -> DataFrame:
    gone = base.join(matched.where(F.col("status") == "removed").select("id"), "id", "left_semi")
    return gone.select(F.col("id").alias("agent_id"), "name", "path", F.lit("info").alias("drift"))


def confidence_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(agent_id, base, head, drift): only a rise counts as drift."""
    both = base.select("id", F.col("confidence").alias("b")).join(head.select("id", F.col("confidence").alias("h")), "id")
    rose = L.rank(F.col("h"), fv.CONFIDENCES) > L.rank(F.col("b"), fv.CONFIDENCES)
    return both.where(~F.col("b").eqNullSafe(F.col("h"))).select(
        F.col("id").alias("agent_id"), F.col("b").alias("base"), F.col("h").alias("head"), F.when(rose, "medium").alias("drift"))


def changed_agents(items: DataFrame, findings: DataFrame, dimensions: DataFrame, confidence: DataFrame,
                   renamed: DataFrame | None = None) -> DataFrame:
    """(agent_id, drift): every agent with any change and its worst level."""
    rank = lambda c: L.rank(c, fv.DIFF_LEVELS)
    none = F.lit(None).cast("int")
    marks = [
        items.select("agent_id", rank(F.col("drift")).alias("r")),
        findings.select("agent_id", F.when(F.col("change") == "resolved", 0).alias("r")),
        dimensions.select("agent_id", none.alias("r")),
        confidence.select("agent_id", rank(F.col("drift")).alias("r")),
    ]
    if renamed is not None:
        marks.append(renamed.select(F.col("head_id").alias("agent_id"), none.alias("r")))
    return union(marks).groupBy("agent_id").agg(
        L.level(F.coalesce(F.max("r"), F.lit(0)), fv.DIFF_LEVELS).alias("drift"))


# ------------------------------------------------------------------------ approvals

def first_approvals(approvals: DataFrame) -> DataFrame:
    """The first record of every (agent, kind, value) decides."""
    record = F.min(F.struct("ord", "evidence_fingerprint", "expires")).alias("r")
    return approvals.groupBy("agent_id", "kind", "value").agg(record).select("agent_id", "kind", "value", "r.evidence_fingerprint", "r.expires")


def with_approval(entries: DataFrame, approvals: DataFrame, fingerprints: DataFrame, as_of: str) -> DataFrame:
    """Adds ``approved`` and, for a matching but unusable record, ``stale_reason``.

    ``entries`` has (agent_id, kind, value); ``fingerprints`` is (agent_id, fingerprint) of the head.
    """
    first = first_approvals(approvals).withColumn("_known", F.lit(True))
    joined = entries.join(first, ["agent_id", "kind", "value"], "left").join(
        fingerprints.select("agent_id", F.col("fingerprint").alias("_fp")), "agent_id", "left")
    known = F.coalesce("_known", F.lit(False))
    expired = known & is_expired(as_of)
    changed = known & (F.coalesce("evidence_fingerprint", F.lit("")) != "") & ~F.col("evidence_fingerprint").eqNullSafe(F.col("_fp"))
    return joined.select(
        *entries.columns, (known & ~expired & ~changed).alias("approved"),
        F.when(expired, "expired").when(changed, "evidence changed").alias("stale_reason"))


def stale_approvals(with_approval_: DataFrame) -> DataFrame:
    return with_approval_.where(F.col("stale_reason").isNotNull()).select(
        "agent_id", "kind", "value", F.col("stale_reason").alias("reason")).distinct()


def summarize(matched: DataFrame, approved_items: DataFrame, approved_added: DataFrame, changed: DataFrame,
              items: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: the summary of a diff. Escalations are added capabilities and integrations only."""
    from auditspark.functions.tables import side_by_side

    rank = lambda c: L.rank(c, fv.DIFF_LEVELS)
    entries = approved_items.select(F.lit(1).alias("esc"), "drift", "approved").unionByName(
        approved_added.select(F.lit(0).alias("esc"), "drift", "approved"))
    parts = [
        matched.agg(F.count_if(F.col("status") == "added").alias("agents_added"), F.count_if(F.col("status") == "removed").alias("agents_removed")),
        changed.agg(F.count(F.lit(1)).alias("agents_changed")),
        entries.agg(
            *[F.count_if((F.col("esc") == 1) & (F.col("drift") == lv)).alias(f"escalations_{lv}") for lv in ("high", "medium", "low")],
            F.coalesce(F.max(rank(F.col("drift"))), F.lit(0)).alias("_max"),
            F.coalesce(F.max(F.when(~F.col("approved"), rank(F.col("drift")))), F.lit(0)).alias("_open"),
            F.count_if("approved").alias("approvals_applied")),
        items.where((F.col("change") == "removed") & F.col("kind").isin(list(ITEM_KINDS))).agg(F.count_distinct("agent_id").alias("reductions")),
        findings.agg(
            F.count_if((F.col("change") == "new") & (F.col("severity") == "critical")).alias("new_critical"),
            F.count_if((F.col("change") == "new") & (F.col("severity") == "high")).alias("new_high"),
            F.count_if(F.col("change") == "resolved").alias("resolved")),
    ]
    row = side_by_side(parts)
    return row.withColumns({
        "max_drift": L.level(F.col("_max"), fv.DIFF_LEVELS), "unapproved_max_drift": L.level(F.col("_open"), fv.DIFF_LEVELS),
    }).drop("_max", "_open")


def diff_gate(summary: DataFrame, fail_on: str) -> bool:
    if fail_on not in fv.DIFF_LEVELS:
        return False
    reached = fv.DIFF_LEVELS[fv.DIFF_LEVELS.index(fail_on):]
    return not summary.where(F.col("unapproved_max_drift").isin(reached)).isEmpty()


def dimension_gate(dimension_changes_: DataFrame, dimension: str, level: str) -> bool:
    """Whether any changed agent rose to at least the level in the dimension."""
    reached = fv.EXPOSURES[fv.EXPOSURES.index(level):]
    return not dimension_changes_.where(
        (F.col("dimension") == dimension) & (F.col("direction") == "increased") & F.col("to").isin(reached)).isEmpty()


def changelog(items: DataFrame, added: DataFrame, removed: DataFrame, findings: DataFrame) -> DataFrame:
    """(section, agent_id, change, drift, approved): one table for all parts of a changelog.

    ``items`` and ``added`` carry ``approved`` where they were checked against approvals.
    """
    approved = lambda df: F.col("approved") if "approved" in df.columns else F.lit(None).cast("boolean")
    shown = items.where(F.col("kind").isin(list(ITEM_KINDS)))
    none = F.lit(None).cast("boolean")
    return union([
        shown.where(F.col("change") == "added").select(
            F.lit("escalation").alias("section"), "agent_id", F.concat(F.lit("+ "), "value").alias("change"), "drift", approved(items).alias("approved")),
        added.select(F.lit("new agent").alias("section"), "agent_id", F.col("reason").alias("change"), "drift", approved(added).alias("approved")),
        shown.where(F.col("change") == "removed").select(
            F.lit("reduction").alias("section"), "agent_id", F.concat(F.lit("- "), "value").alias("change"), "drift", none.alias("approved")),
        removed.select(F.lit("reduction").alias("section"), "agent_id", F.lit("agent no longer detected").alias("change"), "drift", none.alias("approved")),
        findings.where(F.col("change") == "new").select(
            F.lit("finding").alias("section"), "agent_id", F.concat_ws(" ", F.lit("new"), "severity", "rule_id").alias("change"),
            F.col("severity").alias("drift"), none.alias("approved")),
    ])
