"""Event-sourced claim states: validation, evidence fold, projection, static baseline.

events(claim_id, seq, event_type, actor, evidence_id, source, replace_valid, superseded_by, override_status),
claims(claim_id, strength). Every rule is an aggregate over one claim's events, so a claim's history is
never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The event log's vocabulary.
TYPES = ("add_support", "add_refute", "delete_evidence", "replace_span", "add_superseding", "human_override")
ACTORS = ("proposer", "critic", "judge", "human", "retraction_notice")


def rejects(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Events with the reason why they aren't taken: type, actor, unknown claim, sequence that doesn't rise."""
    before = F.max("seq").over(Window.partitionBy("claim_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("_before", before).join(claims.select("claim_id", F.lit(True).alias("_known")), "claim_id", "left")
    reason = (
        F.when(~F.col("event_type").isin(*TYPES), "unknown_type").when(~F.col("actor").isin(*ACTORS), "unknown_actor")
        .when(F.col("_known").isNull(), "unknown_claim").when(F.col("seq") <= F.col("_before"), "sequence")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").drop("_before", "_known")


def evidence_states(events: DataFrame) -> DataFrame:
    """E02 as a fold: (claim_id, evidence_id, ended, added, newest), each the greatest of its kind by seq.

    ended: the last deletion or invalid replacement; added: the last add_* with its kind; newest: the last add_* or valid
    replacement with its source. Greatest values don't depend on the order of events, so the same fold is a stream's state.
    """
    rows = events.where(F.col("evidence_id").isNotNull() & F.col("event_type").isin(*TYPES[:4]))
    added = F.col("event_type").isin("add_support", "add_refute")
    ends = (F.col("event_type") == "delete_evidence") | ((F.col("event_type") == "replace_span") & ~F.coalesce("replace_valid", F.lit(False)))
    return rows.groupBy("claim_id", "evidence_id").agg(
        F.max(F.when(ends, F.col("seq"))).alias("ended"), F.max(F.when(added, F.struct("seq", F.col("event_type").alias("kind")))).alias("added"), F.max(F.when(~ends, F.struct("seq", "source"))).alias("newest"),
    )


def claim_events(events: DataFrame) -> DataFrame:
    """(claim_id, newest, next): a claim's newest event with its override, and its newest superseding event, by seq."""
    return events.groupBy("claim_id").agg(
        F.max(F.struct("seq", "event_type", "override_status")).alias("newest"),
        F.max(F.when((F.col("event_type") == "add_superseding") & (F.coalesce(F.col("superseded_by").cast("string"), F.lit("")) != ""), F.struct("seq", "superseded_by"))).alias("next"),
    )


def alive(states: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, kind, source) of evidence_states() that stand: whatever came after the last end.

    The kind is that of the last add_* after the end, add_support where there is none.
    """
    after = lambda c: F.col(f"{c}.seq") > F.coalesce("ended", F.lit(-(1 << 62)))
    kind = F.coalesce(F.when(after("added"), F.col("added.kind")), F.lit("add_support"))
    return states.where(after("newest")).select("claim_id", "evidence_id", kind.alias("kind"), F.col("newest.source").alias("source"))


def valid_evidence(events: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, kind, source) after all events."""
    return alive(evidence_states(events))


def projection(events: DataFrame, claims: DataFrame) -> DataFrame:
    """states() of a whole log."""
    return states(evidence_states(events), claim_events(events), claims)


def states(evidence: DataFrame, newest: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, status, layer, superseded_by, held, reason, n_support, n_refute, n_sources) by the first rule that holds.

    evidence_states(), claim_events() and claims(claim_id, strength). 1 no event: candidate; 2 the newest event is a human's
    override: its status; 3 the newest successor has valid evidence: superseded; 4 no evidence: rejected; 5 an absolute
    claim with under two sources: rejected; 6 refutation only: rejected; both kinds: needs_review; two sources or more:
    accepted; else needs_review.
    """
    standing = alive(evidence)
    counts = standing.groupBy("claim_id").agg(
        F.count(F.when(F.col("kind") == "add_support", 1)).alias("n_support"), F.count(F.when(F.col("kind") == "add_refute", 1)).alias("n_refute"),
        F.countDistinct(F.when((F.col("kind") == "add_support") & (F.coalesce("source", F.lit("")) != ""), F.col("source"))).alias("n_sources"))
    backed = standing.select(F.col("claim_id").alias("_next")).distinct().withColumn("_backed", F.lit(True))
    rows = claims.join(newest, "claim_id", "left").join(counts, "claim_id", "left").withColumn("_next", F.col("next.superseded_by")).join(backed, "_next", "left")
    s, r, n = (F.coalesce(c, F.lit(0)) for c in ("n_support", "n_refute", "n_sources"))
    over = F.coalesce(F.col("newest.event_type") == "human_override", F.lit(False))
    replaced = F.col("_backed").isNotNull()
    rules = [
        (F.col("newest").isNull(), "candidate", "no_event"), (over, F.col("newest.override_status"), "human_override"), (replaced, "superseded", "newer_successor"), (s + r == 0, "rejected", "no_valid_evidence"),
        ((F.col("strength") == "absolute") & (n < 2), "rejected", "absolute_claim_weak"), (s == 0, "rejected", "refuted_no_support"), (r > 0, "needs_review", "contested"), (n >= 2, "accepted", "several_sources"),
    ]
    pick = lambda k, rest: F.coalesce(*(F.when(rule[0], F.lit(rule[k])) for rule in rules), F.lit(rest))
    layer = F.when((s > 0) & (r > 0), "contested").when(r > 0, "refuted").when(s > 0, "supported").otherwise("unsupported")
    return rows.select(
        "claim_id", pick(1, "needs_review").alias("status"), layer.alias("layer"), F.when(~over & replaced, F.col("_next")).alias("superseded_by"), over.alias("held"), pick(2, "single_source").alias("reason"),
        s.cast("long").alias("n_support"), r.cast("long").alias("n_refute"), n.cast("long").alias("n_sources"),
    )


def static_baseline(events: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, status) by last write: what the newest status-giving event says, blind to later evidence."""
    gives = F.when(F.col("event_type") == "human_override", F.col("override_status")).when(F.col("event_type") == "add_superseding", "superseded").when(F.col("event_type") == "add_refute", "rejected").when(F.col("event_type") == "add_support", "accepted")
    last = events.withColumn("_s", gives).where("_s IS NOT NULL").groupBy("claim_id").agg(F.max(F.struct("seq", "_s"))["_s"].alias("status"))
    return claims.select("claim_id").join(last, "claim_id", "left").select("claim_id", F.coalesce("status", F.lit("candidate")).alias("status"))


# Adjudication of proposed claims.


def judged(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims(claim_id, relation, confidence, flagged, blocked), evidence(claim_id, paper_id, grade_a) of valid spans.

    score = confidence + min(.10, .05 n) + .05 for two papers + min(.09, .03 A-graded papers) - penalties
    (.45 without evidence, .45 absolute, .08 under .7, .32 flagged), inside [0, .99].
    """
    per = evidence.groupBy("claim_id").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("papers"), F.countDistinct(F.when(F.col("grade_a"), F.col("paper_id"))).alias("a"))
    rows = claims.join(per, "claim_id", "left").fillna(0, ["n", "papers", "a"])
    absolute = F.lower("relation").isin("guarantees", "proves")
    bonus = F.least(F.lit(0.10), 0.05 * F.col("n")) + F.when(F.col("papers") >= 2, 0.05).otherwise(0.0) + F.least(F.lit(0.09), 0.03 * F.col("a"))
    penalty = F.when(F.col("n") == 0, 0.45).otherwise(0.0) + F.when(absolute, 0.45).otherwise(0.0) + F.when(F.col("confidence") < 0.7, 0.08).otherwise(0.0) + F.when(F.col("flagged"), 0.32).otherwise(0.0)
    rows = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("confidence") + bonus - penalty)), 6))
    stopped = F.col("blocked") | absolute | (F.col("n") == 0)
    status = F.when((F.col("score") >= 0.78) & ~stopped, "accepted").when((F.col("score") >= 0.58) & (F.col("n") > 0), "needs_review").otherwise("rejected")
    return rows.select("claim_id", F.col("n").alias("n_evidence"), "score", status.alias("status"))


def variants(claims: DataFrame) -> DataFrame:
    """(claim_id, variant, accepted) for claims(claim_id, confidence, valid, triad_score)."""
    c, valid = F.col("confidence"), F.col("valid")
    votes = sum(F.when(c >= t, 1).otherwise(0) for t in (0.70, 0.72, 0.74))
    rules = F.array(
        F.struct(F.lit("rule").alias("variant"), (c >= 0.78).alias("accepted")), F.struct(F.lit("single_pass").alias("variant"), (valid & (c >= 0.72)).alias("accepted")),
        F.struct(F.lit("vote").alias("variant"), (valid & (votes >= 2)).alias("accepted")), F.struct(F.lit("triad").alias("variant"), (valid & (F.col("triad_score") >= 0.78)).alias("accepted")),
    )
    return claims.select("claim_id", F.explode(rules).alias("v")).select("claim_id", "v.variant", "v.accepted")


def criticisms(relations: DataFrame, constraints: DataFrame) -> DataFrame:
    """relations(relation_id, source_id, target_id, source_type, target_type, type, n_evidence) with their faults and status."""
    rows = relations.join(constraints, "type", "left")
    checks = F.array(
        F.when(F.col("source_id") == F.col("target_id"), "source_equals_target"), F.when(F.col("source_type").isNull() | F.col("target_type").isNull(), "unknown_endpoint"),
        F.when(F.col("sources").isNull(), "out_of_schema"), F.when(~(F.array_contains("sources", F.col("source_type")) & F.array_contains("targets", F.col("target_type"))), "schema_type_mismatch"),
        F.when(F.col("n_evidence") == 0, "missing_evidence"), F.when(F.col("type") == "RELATED_TO", "generic_relation"),
    )
    rows = rows.withColumn("faults", F.array_compact(checks))
    fatal = F.arrays_overlap("faults", F.array(*map(F.lit, ("source_equals_target", "unknown_endpoint", "out_of_schema", "schema_type_mismatch", "missing_evidence"))))
    status = F.when(fatal, "rejected").when((F.col("confidence") >= 0.72) & (F.size("faults") == 0), "accepted").otherwise("needs_review")
    return rows.withColumn("status", status)
