"""Summaries of decisions, frequencies, communities, runs, panels and domains (A18, A19, A22, A34, A36, A38, W10), and record mappers.

Defined cases: null statuses and flags count as none; empty tables give no rows (frequency_report: one row of zeros); null
keys join nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.metrics import wilson_ablation
from lumenspan.functions.text import strip_markup

CROSSREF = "DOI string, title array<string>, abstract string, published struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string>>, subject array<string>, URL string, publisher string"
SCHOLAR = "paperId string, title string, abstract string, year int, publicationDate string, venue string, url string, externalIds struct<DOI:string>, openAccessPdf struct<url:string,status:string>, authors array<struct<name:string>>, fieldsOfStudy array<string>"


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _share(a: Column, b: Column, digits: int = 3) -> Column:
    return F.round(F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0)), digits)


def variant_report(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """decisions(variant, claim_id, status, gold) and evidence(claim_id, paper_id, valid) to a row for each variant.

    Precision, recall, F1, unsupported acceptance and evidence coverage (accepted claims whose evidence is all valid, some at
    least), each with its interval, true triples for each of their papers, and all counts.
    """
    whole = evidence.groupBy("claim_id").agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("_whole"))
    rows = decisions.join(whole, "claim_id", "left").withColumns({"_a": F.coalesce(F.col("status") == "accepted", F.lit(False)), "_g": F.coalesce("gold", F.lit(False))})
    out = rows.groupBy("variant").agg(
        _n(F.col("_a")).alias("n_accepted"), _n(F.col("status") == "needs_review").alias("n_review"), _n(F.col("status") == "rejected").alias("n_rejected"), _n(F.col("_g")).alias("n_supported"), _n(~F.col("_g")).alias("n_unsupported"),
        _n(F.col("_a") & F.col("_g")).alias("tp"), _n(F.col("_a") & ~F.col("_g")).alias("fp"), _n(~F.col("_a") & F.col("_g")).alias("fn"), _n(F.col("_a") & F.col("_whole")).alias("n_complete"),
    )
    papers = rows.where("_a AND _g").select("variant", "claim_id").join(evidence.select("claim_id", "paper_id"), "claim_id").groupBy("variant").agg(F.countDistinct("paper_id").alias("n_papers"))
    out = out.join(papers, "variant", "left").na.fill(0, ["n_papers"])
    c = F.col
    rates = {"precision": (c("tp"), c("tp") + c("fp")), "recall": (c("tp"), c("n_supported")), "unsupported_rate": (c("fp"), c("n_unsupported")), "coverage": (c("n_complete"), c("n_accepted"))}
    columns = {"f1": _share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), "yield_per_paper": _share(c("tp"), c("n_papers"))}
    for name, (k, n) in rates.items():
        low, high = wilson_ablation(k, n)
        columns |= {name: _share(k, n), f"{name}_low": low, f"{name}_high": high}
    return out.withColumns(columns)


def frequency_report(df: DataFrame) -> DataFrame:
    """One row over (concept, raw_df, independent_df, duplicate_df): concepts, those with hits and with drops, totals, ratio and greatest drop."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    out = df.agg(
        F.count("*").alias("n_concepts"), _n(F.col("raw_df") > 0).alias("n_hit"), _n(F.col("duplicate_df") > 0).alias("n_drop"), total("raw_df").alias("raw_total"), total("independent_df").alias("independent_total"),
        F.coalesce(F.max("duplicate_df"), F.lit(0)).cast("long").alias("max_drop"),
    )
    return out.withColumn("drop_ratio", _share(F.col("raw_total") - F.col("independent_total"), F.col("raw_total"), 6))


def drop_distribution(df: DataFrame) -> DataFrame:
    """How many concepts lose how many papers to copies."""
    return df.groupBy("duplicate_df").agg(F.count("*").alias("n_concepts"))


def matched_communities(members: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """members(node, community), chosen(node) to the first n (community, size, n_matched, score) by matched members, share (three digits), size, id."""
    hit = chosen.where("node IS NOT NULL").select("node", F.lit(1).alias("_h")).distinct()
    out = members.select("node", "community").distinct().join(hit, "node", "left").groupBy("community").agg(F.count("*").alias("size"), F.count("_h").alias("n_matched")).where("n_matched > 0")
    return out.withColumn("score", F.round(F.col("n_matched") / F.col("size"), 3)).orderBy(F.desc("n_matched"), F.desc("score"), F.desc("size"), "community").limit(n)


def largest_communities(members: DataFrame, n: int) -> DataFrame:
    """The first n (community, size) by size, then id."""
    return members.select("node", "community").distinct().groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(n)


def run_proxies(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """runs(run_id, target, expected, required, covered), claims(run_id, status, n_evidence) to proxies in percent.

    Unsupported among accepted claims (100 where none is), 100 - 20 for each step between target and expected difficulty (0 at
    least), required concepts inside the covered text (100 where none is required).
    """
    accepted = F.col("status") == "accepted"
    per = claims.groupBy("run_id").agg(_n(accepted).alias("n_accepted"), _n(F.col("status") == "rejected").alias("n_rejected"), _n(accepted & (F.coalesce("n_evidence", F.lit(0)) == 0)).alias("_bare"))
    rows = runs.join(per, "run_id", "left").na.fill(0, ["n_accepted", "n_rejected", "_bare"])
    text = F.lower(F.array_join(F.coalesce("covered", F.array().cast("array<string>")), " "))
    rows = rows.withColumn("_text", text).withColumn("_hit", F.size(F.filter("required", lambda c: F.contains(F.col("_text"), F.lower(c)))))
    wanted = F.coalesce(F.size("required"), F.lit(0))
    return rows.select(
        "run_id", F.round(F.when(F.col("n_accepted") > 0, 100 * F.col("_bare") / F.col("n_accepted")).otherwise(100.0), 1).alias("unsupported_rate"),
        F.round(F.greatest(F.lit(0.0), (100 - 20 * F.abs(F.col("target") - F.col("expected"))).cast("double")), 1).alias("adaptation"), F.round(F.when(wanted > 0, 100 * F.col("_hit") / wanted).otherwise(100.0), 1).alias("coverage"), "n_accepted", "n_rejected",
    )


def panel_counts(queues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """queues(panel_id, n_available), verdicts(panel_id, status) to what a panel did and what remains."""
    per = verdicts.groupBy("panel_id").agg(F.count("*").alias("n_processed"), *(_n(F.col("status") == s).alias(f"n_{s}") for s in ("accepted", "needs_review", "rejected")))
    rows = queues.join(per, "panel_id", "left").na.fill(0)
    return rows.select("panel_id", "n_processed", "n_accepted", "n_needs_review", "n_rejected", F.greatest(F.lit(0), F.col("n_available") - F.col("n_processed")).alias("n_remaining"))


def atlas(papers: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """papers(domain, metadata_only), entities(domain, entity_id), relations(domain, relation_id) to a row for each domain with papers."""
    out = papers.where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n_papers"), _n(~F.coalesce("metadata_only", F.lit(False))).alias("n_evidence_papers"), _n(F.col("metadata_only")).alias("n_metadata_only"))
    for name, rows in (("entity", entities), ("relation", relations)):
        out = out.join(rows.groupBy("domain").agg(F.countDistinct(f"{name}_id").alias(f"n_{name}")), "domain", "left")
    return out.na.fill(0, ["n_entity", "n_relation"])


def crossref_papers(records: DataFrame) -> DataFrame:
    """records(value JSON) to papers: without a DOI none; of equal DOIs the smallest record; markup out of the abstract, the title for a missing one."""
    rows = records.select(F.from_json("value", CROSSREF).alias("r"), "value").select("r.*", "value").withColumn("doi", F.lower(F.coalesce("DOI", F.lit(""))))
    one = rows.where("doi <> ''").groupBy("doi").agg(F.min_by(F.struct("title", "abstract", "published", "author", "subject", "URL", "publisher"), "value").alias("r")).select("doi", "r.*")
    title, parts = F.coalesce(F.get("title", F.lit(0)), F.col("doi")), F.coalesce(F.get(F.col("published.date-parts"), F.lit(0)), F.array(F.lit(0)))
    names = F.transform(F.coalesce("author", F.array()), lambda a: F.concat_ws(" ", F.nullif(F.trim(a["given"]), F.lit("")), F.nullif(F.trim(a["family"]), F.lit(""))))
    abstract = strip_markup(F.col("abstract"))
    return one.select(
        F.concat(F.lit("doi:"), "doi").alias("paper_id"), title.alias("title"), names.alias("authors"), F.coalesce(F.get(parts, F.lit(0)), F.lit(0)).alias("year"), F.array_join(parts, "-").alias("published"), F.coalesce("subject", F.array().cast("array<string>")).alias("categories"),
        F.when(abstract != "", abstract).otherwise(title).alias("summary"), F.coalesce(F.nullif("URL", F.lit("")), F.concat(F.lit("https://doi.org/"), "doi")).alias("source_url"), F.lit("scholarly_metadata").alias("source_type"),
        F.coalesce(F.nullif("publisher", F.lit("")), F.lit("Crossref member")).alias("publisher"), F.lit(2).alias("authority_tier"), F.lit("metadata-only").alias("license"),
    )


def scholar_papers(records: DataFrame) -> DataFrame:
    """records(value JSON) to papers: without an id none; the open PDF's address and status before the page's."""
    rows = records.select(F.from_json("value", SCHOLAR).alias("r")).select("r.*").where("coalesce(paperId, '') <> ''")
    title = F.coalesce("title", F.lit(""))
    filled = lambda *some: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in some), F.lit(""))
    return rows.select(
        F.concat(F.lit("s2:"), "paperId").alias("paper_id"), title.alias("title"), F.filter(F.transform(F.coalesce("authors", F.array()), lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "").alias("authors"), F.coalesce("year", F.lit(0)).alias("year"),
        filled("publicationDate").alias("published"), F.coalesce("fieldsOfStudy", F.array().cast("array<string>")).alias("categories"), F.coalesce(F.nullif("abstract", F.lit("")), title).alias("summary"), filled("openAccessPdf.url", "url").alias("source_url"), F.lit("scholarly").alias("source_type"),
        F.coalesce(F.nullif("venue", F.lit("")), F.lit("Semantic Scholar")).alias("publisher"), F.lit(2).alias("authority_tier"), F.coalesce(F.nullif("openAccessPdf.status", F.lit("")), F.lit("metadata-only")).alias("license"), F.lower(filled("externalIds.DOI")).alias("doi"),
    )
