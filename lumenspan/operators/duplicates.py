"""Near-duplicate evidence, clusters and independent document frequency.

Equal wordings are grouped by key and never paired; pairs are looked for among one representative for each
wording. Runs of tokens in more than POSTING wordings propose no pairs, as in the operator's definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import shingles
from lumenspan.operators.components import connected_components
from lumenspan.session import stored

POSTING, SHARED = 200, 3
MARK = "\x01"
NEAR, NEAR_SAME_FACTS, PARAPHRASE = 0.6, 0.4, 0.3


def _wording(tokens: Column) -> Column:
    """128 bits that stand for a list of tokens where rows are dealt by it; a token is never null."""
    return F.struct(F.xxhash64(F.size(tokens), tokens).alias("a"), F.xxhash64(tokens).alias("b"))


def wordings(spans: DataFrame) -> DataFrame:
    """spans(evidence_id, tokens array<string>) to wording(wording_id, tokens, n_spans): the smallest id stands for equal tokens."""
    # on their way tokens are one text, where none holds the separator: a list of strings is several times as large
    some = spans.where(F.size("tokens") > 0).select("evidence_id", _wording(F.col("tokens")).alias("w"), F.array_join("tokens", MARK).alias("t"), F.when(F.exists("tokens", lambda x: x.contains(MARK)), F.col("tokens")).alias("l"))
    held = some.groupBy("w").agg(F.min("evidence_id").alias("wording_id"), F.count("*").alias("n_spans"), F.first("t").alias("t"), F.first("l").alias("l"))
    return held.select("wording_id", F.coalesce("l", F.split("t", MARK, -1)).alias("tokens"), "n_spans")


def near_pairs(words: DataFrame, size: int = 5) -> DataFrame:
    """Pairs (left_id, right_id, similarity, verdict) of wordings that share at least SHARED runs.

    words(wording_id, tokens, entities array, numbers array); a missing array counts as empty. Runs are dealt once, to be
    counted and to be kept where several wordings have them; wordings with fewer than SHARED such runs are in no pair.
    """
    cols = set(words.columns)
    runs = words.select("wording_id", shingles(F.col("tokens"), size).alias("runs")).select("wording_id", F.size("runs").alias("size"), F.explode("runs").alias("run")).repartition("run")
    # every column is used here, so that Spark deals the same rows once for both sides of the join
    counts = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("wording_id").alias("first"), F.max("wording_id").alias("last"), F.max("size").alias("most")).where("first < last AND most > 0").select("run", "n")
    held = runs.join(counts, "run").groupBy("wording_id", "size").agg(F.collect_list(F.when(F.col("n") <= POSTING, F.col("run"))).alias("p"), F.collect_list(F.when(F.col("n") > POSTING, F.col("run"))).alias("c"))
    held = stored(held.where(F.size("p") >= SHARED), "postings")  # two lists as long as a wording has runs
    side = lambda s: held.select(F.col("wording_id").alias(f"{s}_id"), F.col("size").alias(f"{s}_size"), F.explode("p").alias("run"))
    pairs = side("left").join(side("right"), "run").where("left_id < right_id").groupBy("left_id", "right_id", "left_size", "right_size").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    # common runs propose no pairs, but count in those that others proposed
    common = held.where(F.size("c") > 0).select("wording_id", "c")
    both = pairs.join(common.select(F.col("wording_id").alias("left_id"), F.col("c").alias("left_c")), "left_id", "left").join(common.select(F.col("wording_id").alias("right_id"), F.col("c").alias("right_c")), "right_id", "left")
    shared = F.col("n") + F.coalesce(F.size(F.array_intersect("left_c", "right_c")), F.lit(0))
    if {"entities", "numbers"} & cols:
        fact = lambda name: F.col(name) if name in cols else F.array().cast("array<string>")
        facts_of = lambda s: words.select(F.col("wording_id").alias(f"{s}_id"), fact("entities").alias(f"{s}_e"), fact("numbers").alias(f"{s}_n"))
        both = both.join(facts_of("left"), "left_id").join(facts_of("right"), "right_id")
    else:
        none = F.array().cast("array<string>")
        both = both.withColumns({"left_e": none, "right_e": none, "left_n": none, "right_n": none})
    share = shared / (F.col("left_size") + F.col("right_size") - shared)
    facts = (F.size("left_e") > 0) & (F.array_sort("left_e") == F.array_sort("right_e")) & (F.array_sort("left_n") == F.array_sort("right_n"))
    verdict = F.when(share >= NEAR, "near_duplicate").when((share >= NEAR_SAME_FACTS) & facts, "near_duplicate").when(share >= PARAPHRASE, "paraphrase").otherwise("distinct")
    return both.select("left_id", "right_id", F.round(share, 6).alias("similarity"), verdict.alias("verdict"))


def clusters(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """(evidence_id, cluster): 'dup:' and the smallest id of its component of near duplicates and equal wordings; loners have none."""
    rows = spans.where(F.size("tokens") > 0).select("evidence_id", _wording(F.col("tokens")).alias("w"))
    held = rows.groupBy("w").agg(F.min("evidence_id").alias("wording_id"), F.count("*").alias("n_spans"))
    links = pairs.where("verdict = 'near_duplicate'").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))
    found = connected_components(links)
    roots = held.join(found, held["wording_id"] == found["node"], "left").where("component IS NOT NULL OR n_spans > 1").select("w", F.coalesce("component", "wording_id").alias("root"))
    return rows.join(roots, "w").select("evidence_id", F.concat(F.lit("dup:"), F.col("root").cast("string")).alias("cluster"))


def cluster_reports(spans: DataFrame, pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """A row for each cluster: n_members, n_papers, the seed pair (left_id, right_id), greatest and least similarity, n_links.

    spans(evidence_id, paper_id, tokens), pairs of near_pairs(), membership of clusters(). The links of a cluster are its
    near duplicates and, for a wording that several spans share, its two smallest spans at similarity 1; the seed is the
    link with the greatest similarity, then with the smallest ids. Members are never paired.
    """
    held = membership.join(spans.select("evidence_id", "paper_id", _wording(F.col("tokens")).alias("w")), "evidence_id")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("n_members"), F.countDistinct("paper_id").alias("n_papers"))
    first = held.groupBy("w").agg(F.min("evidence_id").alias("left_id"))
    same = held.join(first, "w").where("evidence_id > left_id").groupBy("cluster", "left_id").agg(F.min("evidence_id").alias("right_id")).withColumn("similarity", F.lit(1.0))
    near = pairs.where("verdict = 'near_duplicate'").join(membership.withColumnRenamed("evidence_id", "left_id"), "left_id").select("cluster", "left_id", "right_id", "similarity")
    links = same.select("cluster", "left_id", "right_id", "similarity").unionByName(near)
    best = links.groupBy("cluster").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "left_id", "right_id")).alias("b"), F.min("similarity").alias("min_similarity"), F.count("*").alias("n_links"))
    return sizes.join(best, "cluster").select("cluster", "n_members", "n_papers", "b.left_id", "b.right_id", (-F.col("b.s")).alias("max_similarity"), "min_similarity", "n_links")


def independent_papers(mentions: DataFrame, membership: DataFrame) -> DataFrame:
    """(paper_id, unit): papers that share a cluster are one unit, the smallest of their ids.

    mentions(evidence_id, paper_id), membership(evidence_id, cluster). Papers are linked through their
    cluster's smallest paper, never pairwise.
    """
    held = mentions.select("evidence_id", "paper_id").distinct().join(membership, "evidence_id").select("paper_id", "cluster").distinct()
    least = held.groupBy("cluster").agg(F.min("paper_id").alias("dst"))
    found = connected_components(held.join(least, "cluster").where("paper_id <> dst").select(F.col("paper_id").alias("src"), "dst"))
    papers = mentions.select("paper_id").distinct()
    return papers.join(found, papers["paper_id"] == found["node"], "left").select("paper_id", F.coalesce("component", "paper_id").alias("unit"))


def document_frequency(concepts: DataFrame, units: DataFrame) -> DataFrame:
    """concepts(concept, paper_id) to raw_df, independent_df and duplicate_df."""
    rows = concepts.select("concept", "paper_id").distinct().join(units, "paper_id")
    out = rows.groupBy("concept").agg(F.countDistinct("paper_id").alias("raw_df"), F.countDistinct("unit").alias("independent_df"))
    return out.withColumn("duplicate_df", F.col("raw_df") - F.col("independent_df"))


def frequency_summary(df: DataFrame) -> DataFrame:
    """Totals and the share of the raw frequency that copies make up."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_total")
    out = df.agg(F.count("*").alias("n_concepts"), total("raw_df"), total("independent_df"))
    return out.withColumn("drop_ratio", F.round(F.when(F.col("raw_df_total") > 0, 1 - F.col("independent_df_total") / F.col("raw_df_total")).otherwise(0.0), 6))


def most_copied(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("duplicate_df"), F.desc("raw_df"), "concept").limit(n)


def shared_passages(spans: DataFrame) -> DataFrame:
    """Rank of each span inside its wording: 1 is the one that counts."""
    return spans.withColumn("copy", F.row_number().over(Window.partitionBy("tokens").orderBy("evidence_id")))
