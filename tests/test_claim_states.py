"""Claim states: the fold against one event at a time, and the stream against the batch."""

import random

from pyspark.sql import functions as F

from lumenspan.operators import decisions as D
from lumenspan.streaming import decisions as stream

SCHEMA = "claim_id string, seq long, event_type string, evidence_id string, source string, replace_valid boolean, superseded_by string, override_status string"


def standing(events, claim):
    held = {}
    for _, _, kind, evidence, source, ok, _, _ in (e for e in events if e[0] == claim):
        if kind in ("add_support", "add_refute"):
            held[evidence] = (kind, source)
        elif kind == "delete_evidence":
            held.pop(evidence, None)
        elif kind == "replace_span":
            old = held.pop(evidence, None)
            if ok:
                held[evidence] = (old[0] if old else "add_support", source)
    return held


def state(events, claim, strength):
    mine, held = [e for e in events if e[0] == claim], standing(events, claim)
    s, r = (sum(k == kind for k, _ in held.values()) for kind in ("add_support", "add_refute"))
    n = len({x for k, x in held.values() if k == "add_support" and x})
    layer = "contested" if s and r else "refuted" if r else "supported" if s else "unsupported"
    row = lambda status, reason, after=None, held=False: (claim, status, layer, after, held, reason, s, r, n)
    if not mine:
        return row("candidate", "no_event")
    if mine[-1][2] == "human_override":
        return row(mine[-1][7], "human_override", held=True)
    after = [e[6] for e in mine if e[2] == "add_superseding" and e[6]]
    if after and standing(events, after[-1]):
        return row("superseded", "newer_successor", after[-1])
    if not held:
        return row("rejected", "no_valid_evidence")
    if strength == "absolute" and n < 2:
        return row("rejected", "absolute_claim_weak")
    if not s:
        return row("rejected", "refuted_no_support")
    if r:
        return row("needs_review", "contested")
    return row("accepted", "several_sources") if n >= 2 else row("needs_review", "single_source")


def random_log(rng, n, claims):
    out = []
    for seq in range(n):
        kind = rng.choice([*D.TYPES, "add_support", "delete_evidence"])
        evidence = f"e{rng.randrange(3)}" if kind in D.TYPES[:4] else None
        out.append((f"c{rng.randrange(claims)}", seq, kind, evidence, rng.choice(["s1", "s2", "", None]), rng.choice([True, False, None]), rng.choice([f"c{rng.randrange(claims + 2)}", "", None]) if kind == "add_superseding" else None, rng.choice(["accepted", "rejected"]) if kind == "human_override" else None))
    return out


def test_fold_equals_one_event_at_a_time(spark):
    seen = set()
    for seed in range(4):
        log = random_log(random.Random(seed), 60 + 60 * seed, 12)
        strengths = [(f"c{k}", ["plain", "progressive", "absolute"][k % 3]) for k in range(14)]
        claims = spark.createDataFrame(strengths, "claim_id string, strength string")
        got = sorted(tuple(r) for r in D.projection(spark.createDataFrame(log, SCHEMA), claims).collect())
        want = sorted((state(log, c, s) for c, s in strengths))
        assert got == want
        seen |= {r[5] for r in got}
    assert len(seen) >= 7


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    log = random_log(random.Random(9), 300, 10)
    claims = spark.createDataFrame([(f"c{k}", "absolute" if k % 2 else "plain") for k in range(11)], "claim_id string, strength string")
    want = D.projection(spark.createDataFrame(log, SCHEMA), claims)
    for order in range(2):
        random.Random(order).shuffle(log)
        root = tmp_path / f"run{order}"
        for k in range(6):
            spark.createDataFrame(log[50 * k : 50 * k + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(root / "in"))
        flow = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(root / "in"))
        got = stream.streamed_states(flow, claims, str(root / "out"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        # more events after a restart are folded into the same state
        late = [("c0", 1000, "human_override", None, None, None, None, "accepted")]
        spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(str(root / "in"))
        again = stream.streamed_states(flow, claims, str(root / "out"))
        assert again.where("claim_id = 'c0'").first()["status"] == "accepted"
        assert again.where("claim_id <> 'c0'").exceptAll(want.where("claim_id <> 'c0'")).count() == 0


def test_only_the_newest_successor_counts(spark):
    log = [("a", 1, "add_support", "e", "s", None, None, None), ("b", 2, "add_support", "e", "s", None, None, None), ("a", 3, "add_superseding", None, None, None, "b", None), ("a", 4, "add_superseding", None, None, None, "c", None)]
    claims = spark.createDataFrame([(c, "plain") for c in "abc"], "claim_id string, strength string")
    got = {r["claim_id"]: (r["status"], r["superseded_by"]) for r in D.projection(spark.createDataFrame(log, SCHEMA), claims).collect()}
    assert got == {"a": ("needs_review", None), "b": ("needs_review", None), "c": ("candidate", None)}
    assert D.projection(spark.createDataFrame(log, SCHEMA).limit(0), claims).where(F.col("status") == "candidate").count() == 3
