"""Quality reports as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.metrics import p95, wilson


def kappa(samples: DataFrame) -> DataFrame:
    """A10: one row (n, observed, expected, kappa) for samples(label_1, label_2); rows without both labels don't count."""
    both = samples.where("label_1 IS NOT NULL AND label_2 IS NOT NULL")
    n = both.agg(F.count("*").alias("n"), F.count(F.when(F.col("label_1") == F.col("label_2"), 1)).alias("same"))
    one = both.groupBy(F.col("label_1").alias("label")).agg(F.count("*").alias("a"))
    two = both.groupBy(F.col("label_2").alias("label")).agg(F.count("*").alias("b"))
    chance = one.join(two, "label").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    rows = n.crossJoin(chance)  # one row by one row
    observed, expected = F.col("same") / F.nullif("n", F.lit(0)), F.col("ab") / F.nullif(F.col("n") * F.col("n"), F.lit(0))
    value = F.when(F.col("n") == 0, F.lit(None)).when(expected >= 1, F.when(observed >= 1, 1.0).otherwise(0.0)).otherwise((observed - expected) / (1 - expected))
    return rows.select("n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(value, 6).alias("kappa"))


def hallucination(samples: DataFrame) -> DataFrame:
    """samples(status, label, error): INSUFFICIENT leaves first, whatever its status; of the accepted rest, UNSUPPORTED or erroneous ones count."""
    enough = F.col("label") != "INSUFFICIENT"
    accepted = enough & (F.col("status") == "accepted")
    wrong = accepted & ((F.col("label") == "UNSUPPORTED") | F.coalesce("error", F.lit(False)))
    rows = samples.agg(F.count("*").alias("n"), F.count(F.when(accepted, 1)).alias("n_accepted"), F.count(F.when(wrong, 1)).alias("n_wrong"), F.count(F.when(~enough, 1)).alias("n_insufficient"))
    low, high = wilson(F.col("n_wrong"), F.col("n_accepted"))
    rate = F.coalesce(F.col("n_wrong") / F.nullif("n_accepted", F.lit(0)), F.lit(0.0))
    ratio = F.coalesce(F.col("n_insufficient") / F.nullif("n", F.lit(0)), F.lit(0.0))
    return rows.select("n", "n_accepted", "n_wrong", "n_insufficient", F.round(rate, 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(ratio, 6).alias("insufficient_ratio"), ((high < 0.05) & (F.col("n_accepted") >= 73) & (ratio <= 0.10)).alias("passes"))


def adaptation(records: DataFrame) -> DataFrame:
    """records(path_id, expected, target, required, covered, mastered, targets): gap at most 1, coverage at least .8, mastered share at most .2."""
    share = lambda a, b, none: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(none)
    rows = records.withColumns({c: F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))) for c in ("required", "covered", "mastered", "targets")})
    coverage, known = share(F.col("required"), F.col("covered"), 1.0), share(F.col("targets"), F.col("mastered"), 0.0)
    gap = F.abs(F.col("target") - F.col("expected"))
    return rows.select("path_id", gap.cast("long").alias("gap"), F.round(coverage, 6).alias("coverage"), F.round(known, 6).alias("mastered_share"), ((gap <= 1) & (coverage >= 0.8) & (known <= 0.2)).alias("suitable"))


def coverage(points: DataFrame, hits: DataFrame) -> DataFrame:
    """points(point_id, name, domain), a row for each name of a point, hits(point_id, name, paper_id): loose: a paper; strict: two different papers.

    A hit without a point of its id goes to all points that have its folded name. A point's papers are those of its id and of
    all its names together. Two papers are different if their least and greatest are, so each key carries just these two
    and no point ever meets all its hits. Null papers count for nothing; a point's domain is its greatest one.
    """
    key = lambda c: F.lower(F.trim(c))
    ends = [F.min("paper_id").alias("low"), F.max("paper_id").alias("high")]
    ids = points.select("point_id").distinct()
    by_id = hits.join(ids, "point_id", "left_semi").groupBy("point_id").agg(*ends)
    by_name = hits.join(ids, "point_id", "left_anti").groupBy(key("name").alias("_k")).agg(*ends)
    named = points.select("point_id", key("name").alias("_k")).distinct().join(by_name, "_k").select("point_id", "low", "high")
    papers = by_id.unionByName(named).groupBy("point_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = points.groupBy("point_id").agg(F.max("domain").alias("domain")).join(papers, "point_id", "left").select(F.coalesce("domain", F.lit("(no domain)")).alias("domain"), "low", "high")
    out = rows.groupBy("domain").agg(F.count("*").alias("n_points"), F.count("low").alias("n_loose"), F.count(F.when(F.col("low") < F.col("high"), 1)).alias("n_strict"))
    return out.withColumns({"loose": F.round(F.col("n_loose") / F.col("n_points"), 6), "strict": F.round(F.col("n_strict") / F.col("n_points"), 6)})


def real_cases(cases: DataFrame) -> DataFrame:
    """cases(source, paper_id, page, char_start, char_end, quote): real ones name paper, place and quote and aren't synthetic."""
    real = (F.coalesce("source", F.lit("")) != "synthetic") & (F.coalesce("paper_id", F.lit("")) != "") & (F.coalesce("page", F.lit("")) != "") & (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & (F.coalesce("quote", F.lit("")) != "")
    return cases.agg(F.count("*").alias("pool"), F.count(F.when(real, 1)).alias("n_real")).withColumn("passes", F.col("n_real") >= 50)


def variant_metrics(rows: DataFrame) -> DataFrame:
    """rows(variant, accepted, gold) to precision, recall and F1 by variant, 0 where nothing counts."""
    n = lambda cond: F.count(F.when(cond, 1))
    out = rows.groupBy("variant").agg(n(F.col("accepted") & F.col("gold")).alias("tp"), n(F.col("accepted") & ~F.col("gold")).alias("fp"), n(~F.col("accepted") & F.col("gold")).alias("fn"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return out.withColumns({"precision": F.round(safe(F.col("tp"), F.col("tp") + F.col("fp")), 6), "recall": F.round(safe(F.col("tp"), F.col("tp") + F.col("fn")), 6), "f1": F.round(safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)})


def timing(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, population deviation, p95 by its index formula, and runs a second, by group."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.collect_list(value).alias("_v"), F.sum(value).alias("_t"))
    return out.select(group, "n", F.round("_m", 4).alias("mean"), F.round("_s", 4).alias("std"), F.round(p95(F.col("_v")), 6).alias("p95"), F.round(F.col("n") / F.nullif("_t", F.lit(0.0)), 6).alias("rate"))


def timing_large(rows: DataFrame, group: str, value: str) -> DataFrame:
    """A20 for groups of any size: the p95 row is picked by its rank from value counts, and no group is collected."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.sum(value).alias("_t"))
    place = F.least(F.col("n") - 1, F.greatest(F.lit(0), F.bround(0.95 * F.col("n") + 0.5).cast("long") - 1))
    at = ranked.join(base, group).where((F.col("_to") > place) & (F.col("_to") - F.col("c") <= place))
    return at.select(group, "n", F.round("_m", 4).alias("mean"), F.round("_s", 4).alias("std"), F.round(value, 6).alias("p95"), F.round(F.col("n") / F.nullif("_t", F.lit(0.0)), 6).alias("rate"))


def topic_clusters(concepts: DataFrame, papers: DataFrame, anchors: int) -> DataFrame:
    """concepts(paper_id, concept), papers(paper_id, year): the `anchors` commonest concepts draw papers.

    A paper goes to its anchor of the highest document frequency (ties: the name); papers without any go to
    the first anchor, as the operator defines it.
    """
    df = concepts.groupBy("concept").agg(F.countDistinct("paper_id").alias("df"))
    chosen = df.orderBy(F.desc("df"), "concept").limit(anchors)
    best = concepts.join(F.broadcast(chosen), "concept").groupBy("paper_id").agg(F.min(F.struct((-F.col("df")).alias("d"), "concept"))["concept"].alias("anchor"))
    first = chosen.agg(F.min(F.struct((-F.col("df")).alias("d"), "concept"))["concept"].alias("_first"))
    rows = papers.join(best, "paper_id", "left").crossJoin(F.broadcast(first)).select("paper_id", "year", F.coalesce("anchor", "_first").alias("anchor"))
    return rows.groupBy("anchor").agg(F.count("*").alias("n_papers"), F.round(F.avg("year"), 4).alias("avg_year"))
