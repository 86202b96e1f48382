"""Joins, counts, rankings and changes of the literature library (J, A, W, U and M rows).

All take DataFrames with the logical columns named in each docstring. Ties are broken by ids, so results
are total orders; whole-result fallbacks are unions with an existence test, never a per-row coalesce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import words


def paper_counts(papers: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """papers(paper_id) with evidence_count and distinct relation_count, 0 where there are none.

    evidence(evidence_id, paper_id), links(relation_id, evidence_id).
    """
    spans = evidence.groupBy("paper_id").agg(F.count("*").alias("evidence_count"))
    relations = links.join(evidence, "evidence_id").groupBy("paper_id").agg(F.countDistinct("relation_id").alias("relation_count"))
    out = papers.select("paper_id").join(spans, "paper_id", "left").join(relations, "paper_id", "left")
    return out.select("paper_id", F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"), F.coalesce("relation_count", F.lit(0)).cast("long").alias("relation_count"))


def relations_of(relations: DataFrame, links: DataFrame, evidence: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct relations with evidence in the given papers(paper_id)."""
    touched = links.join(evidence.join(papers.select("paper_id"), "paper_id", "left_semi"), "evidence_id").select("relation_id").distinct()
    return relations.join(touched, "relation_id", "left_semi")


def nested_evidence(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """relation_id and its spans ordered by (paper_id, char_start, evidence_id)."""
    spans = F.array_sort(F.collect_list(F.struct("paper_id", "char_start", "evidence_id")))
    return links.join(evidence, "evidence_id").groupBy("relation_id").agg(spans.alias("evidence"))


def grouped_total(rows: DataFrame, keys: list[str], distinct: str, total: str) -> DataFrame:
    """Distinct members and a total that is 0 where there is none."""
    return rows.groupBy(*keys).agg(F.countDistinct(distinct).alias("n_members"), F.coalesce(F.sum(total), F.lit(0)).alias("total"))


def top(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The first n rows, of each group if there are groups, with their rank."""
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def insert_ignore(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Held, and the new rows whose key isn't there (the first of each key by its whole row)."""
    fresh = new.join(held.select(key), key, "left_anti")
    rest = [c for c in new.columns if c != key]
    one = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return held.unionByName(one.select(*held.columns))


def upsert_papers(held: DataFrame, new: DataFrame) -> DataFrame:
    """(paper_id, summary, tier, license, title): the longer summary (ties: new), the least tier, the new licence unless empty, else overwrite."""
    a, b = held.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.paper_id") == F.col("b.paper_id"), "full_outer")
    newer = F.col("b.paper_id").isNotNull()
    older = F.col("a.paper_id").isNotNull()
    longer = F.length("b.summary") >= F.length("a.summary")
    return both.select(
        F.coalesce("b.paper_id", "a.paper_id").alias("paper_id"),
        F.when(newer & (~older | longer), F.col("b.summary")).otherwise(F.col("a.summary")).alias("summary"),
        F.least("a.tier", "b.tier").alias("tier"),
        F.when(newer & (F.coalesce("b.license", F.lit("")) != ""), F.col("b.license")).otherwise(F.col("a.license")).alias("license"),
        F.when(newer, F.col("b.title")).otherwise(F.col("a.title")).alias("title"),
    )


def cascade_delete(gone: DataFrame, tables: dict[str, DataFrame], key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without rows of the given keys, and (table_name, deleted) counts."""
    left = {n: t.join(gone.select(key), key, "left_anti") for n, t in tables.items()}
    counts = None
    for name, t in tables.items():
        one = t.join(gone.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def version_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or unchanged."""
    a, b = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("unchanged").alias("change"))


def first_of_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the parts in order of precedence, the first of each key."""
    rest = [c for c in parts[0].columns if c != key]
    rows = None
    for k, part in enumerate(parts):
        part = part.select(key, F.struct(F.lit(k).alias("_part"), *rest).alias("_r"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(key).agg(F.min("_r").alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest), F.col("_r._part").alias("part"))


def federated(papers: DataFrame) -> DataFrame:
    """One row for each DOI, else canonical address, else id: the least tier, then the longest summary, then the id."""
    url = F.lower(F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", ""))
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.lower("doi")).when(url != "", url).otherwise(F.col("paper_id").cast("string"))
    order = Window.partitionBy("dedupe_key").orderBy("tier", F.desc(F.length(F.coalesce("summary", F.lit("")))), "paper_id")
    return papers.withColumn("dedupe_key", key).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def search(papers: DataFrame, query: list[str], limit: int) -> DataFrame:
    """papers(paper_id, text, year) by substring hits + .01 (year - 2020); if nothing scores, the newest unscored ones."""
    low = F.lower("text")
    score = sum((F.when(low.contains(q.lower()), 1.0).otherwise(0.0) for q in query), F.lit(0.0)) + 0.01 * (F.col("year") - 2020)
    scored = papers.withColumn("score", F.round(score, 6))
    hit = scored.where("score > 0")
    none = hit.limit(1).agg(F.count("*").alias("_hits"))
    spare = scored.join(F.broadcast(none), F.col("_hits") == 0).drop("_hits").withColumn("score", F.lit(0.0))
    return hit.unionByName(spare).orderBy(F.desc("score"), F.desc("year"), "paper_id").limit(limit)


def candidates(project: DataFrame, corpus: DataFrame, limit: int) -> DataFrame:
    """(relation_id, source, relation_type, target, accepted, confidence, n_evidence): the project's first, one for each folded triple."""
    rows = project.withColumn("origin", F.lit(0)).unionByName(corpus.withColumn("origin", F.lit(1)))
    order = ["origin", F.desc("accepted"), F.desc("confidence"), F.desc("n_evidence"), "relation_id"]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("source"), "relation_type", F.lower("target")).orderBy(*order)))
    return rows.where("_n = 1").drop("_n").orderBy(*order).limit(limit)


def seeds(entities: DataFrame, query: str, limit: int = 4) -> DataFrame:
    """entities(entity_id, alias, degree): +3 for an alias of 3 or more letters inside the query, +1 for each shared token.

    Kept: scores of at least max(2, half of the best), by (score, degree, id) descending; without any, the
    three of the highest degree.
    """
    low = query.lower()
    tokens = set(low.split())
    shared = F.size(F.array_intersect(F.split(F.lower("alias"), " "), F.array(*map(F.lit, sorted(tokens)))))
    score = F.when((F.length("alias") >= 3) & F.lit(low).contains(F.lower("alias")), 3).otherwise(0) + shared
    scored = entities.withColumn("score", score.cast("long"))
    best = scored.agg(F.max("score").alias("_best"))
    kept = scored.join(F.broadcast(best), F.col("score") >= F.greatest(F.lit(2.0), 0.5 * F.col("_best"))).drop("_best")
    kept = kept.orderBy(F.desc("score"), F.desc("degree"), F.desc("entity_id")).limit(limit)
    spare = scored.join(F.broadcast(best), F.col("_best") < 2).drop("_best").orderBy(F.desc("degree"), F.desc("entity_id")).limit(3)
    return kept.unionByName(spare)


def overlap_select(papers: DataFrame, query: str, limit: int) -> DataFrame:
    """papers(paper_id, title, year) by shared title words; if none shares any, the newest."""
    terms = sorted({w for w in query.lower().split() if len(w) > 2})
    scored = papers.withColumn("overlap", F.size(F.array_intersect(words(F.col("title")), F.array(*map(F.lit, terms)).cast("array<string>"))).cast("long"))
    best = scored.agg(F.max("overlap").alias("_best"))
    return scored.join(F.broadcast(best), (F.col("overlap") > 0) | (F.col("_best") == 0)).drop("_best").orderBy(F.desc("overlap"), F.desc("year"), "paper_id").limit(limit)


def gaps(relations: DataFrame, limit: int = 5) -> DataFrame:
    """Methods that address a task and data sets that benchmark it, without an evaluation of the pair.

    relations(source, relation_type, target, confidence).
    """
    addresses = relations.where("relation_type = 'ADDRESSES'").groupBy(F.col("source").alias("method"), F.col("target").alias("task")).agg(F.max("confidence").alias("_a"))
    benchmarks = relations.where("relation_type = 'BENCHMARKS'").groupBy(F.col("source").alias("dataset"), F.col("target").alias("task")).agg(F.max("confidence").alias("_b"))
    known = relations.where("relation_type = 'EVALUATES_ON'").select(F.col("source").alias("method"), F.col("target").alias("dataset"))
    ideas = addresses.join(benchmarks, "task").join(known, ["method", "dataset"], "left_anti")
    ideas = ideas.select("method", "task", "dataset", F.round(F.col("_a") + F.col("_b"), 6).alias("score"))
    return ideas.orderBy(F.desc("score"), "method", "task", "dataset").limit(limit)
