"""Catalogues, imports, reports and receipts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import singular
from lumenspan.session import ship


def catalogue_search(entries: DataFrame, query: list[str], limit: int) -> DataFrame:
    """entries(entry_id, text, year) by shared tokens, none dropped out, then newest."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = entries.withColumn("score", F.size(F.array_intersect(tokens, F.array(*map(F.lit, sorted(set(query)))))).cast("long"))
    return rows.where("score > 0").orderBy(F.desc("score"), F.desc("year"), "entry_id").limit(limit).select("entry_id", "year", "score")


def labels_for(records: DataFrame, labels: DataFrame) -> DataFrame:
    """records(path_id, position) with the verdict of labels(path_id, position, verdict): by id, else by place among labels without an id."""
    by_id = labels.where("path_id IS NOT NULL").groupBy("path_id").agg(F.min_by("verdict", "position").alias("_a"))
    by_place = labels.where("path_id IS NULL").select("position", F.col("verdict").alias("_b"))
    return records.join(by_id, "path_id", "left").join(by_place, "position", "left").select("path_id", F.coalesce("_a", "_b").alias("verdict"))


def imported(held: DataFrame, store: DataFrame, links: DataFrame, papers: DataFrame, limit: int) -> DataFrame:
    """Relation ids of the store with evidence in the papers that the project lacks, at most `limit` by id."""
    wanted = links.join(papers, "paper_id", "left_semi").select("relation_id").distinct()
    return store.join(wanted, "relation_id", "left_semi").join(held, "relation_id", "left_anti").orderBy("relation_id").limit(limit)


def with_missing_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities(name, kind) and one of kind 'inferred' for each relation end, by folded name, that has none."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("name")).withColumn("_k", F.lower(F.trim("name")))
    rest = ends.join(entities.select(F.lower(F.trim("name")).alias("_k")), "_k", "left_anti").groupBy("_k").agg(F.min("name").alias("name"))
    return entities.select("name", "kind").unionByName(rest.select("name", F.lit("inferred").alias("kind")))


def report_verdict(rows: DataFrame) -> DataFrame:
    """rows(run_id, block, passes, example): a run passes if all its blocks do; example data can never claim."""
    return rows.groupBy("run_id").agg(F.count("*").alias("n_blocks"), F.bool_and("passes").alias("_p"), F.bool_or("example").alias("_e")).select(
        "run_id", "n_blocks", F.when(F.col("_e"), "example_only").when(F.col("_p"), "passes").otherwise("fails").alias("verdict"))


def literature_map(papers: DataFrame, disputes: DataFrame, gaps: DataFrame) -> DataFrame:
    """papers(topic, paper_id, grade), disputes(topic), gaps(topic): representatives, A grades, controversies and gaps of each topic."""
    order = Window.partitionBy("topic").orderBy("grade", "paper_id")
    first = papers.withColumn("_n", F.row_number().over(order)).where("_n <= 3").groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("paper_id").cast("string").alias("p")))), lambda x: x["p"]), "|").alias("representatives"))
    counts = papers.groupBy("topic").agg(F.count(F.when(F.col("grade") == "A", 1)).alias("n_a"))
    n = lambda df, name: df.groupBy("topic").agg(F.count("*").alias(name))
    return first.join(counts, "topic").join(n(disputes, "n_disputes"), "topic", "left").join(n(gaps, "n_gaps"), "topic", "left").fillna(0)


def expected_terms(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """cases(case_id, terms), claims(case_id, text, status): share of terms inside accepted or reviewed claims."""
    kept = claims.where(F.col("status").isin("accepted", "needs_review")).select("case_id", F.lower("text").alias("_t"))
    each = cases.select("case_id", F.explode(F.array_distinct("terms")).alias("term"))
    hit = each.join(kept, "case_id").where(F.contains(F.col("_t"), F.lower("term"))).select("case_id", "term").distinct().groupBy("case_id").agg(F.count("*").alias("_h"))
    return cases.join(hit, "case_id", "left").select("case_id", F.round(F.when(F.size("terms") > 0, F.coalesce("_h", F.lit(0)) / F.size(F.array_distinct("terms"))).otherwise(1.0), 6).alias("coverage"))


def strongest_baseline(variants: DataFrame, ours: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """variants(variant, value): the best of the others (ties by name), and our gain in points of a hundred."""
    rest = variants.where((F.col("variant") != ours) & ~F.col("variant").isin(*skip, ""))
    best = rest.agg(F.max(F.struct("value", "variant")).alias("b"))
    own = variants.where(F.col("variant") == ours).agg(F.max("value").alias("_v"))
    return best.crossJoin(own).select(F.col("b.variant").alias("baseline"), F.round(100 * (F.col("_v") - F.col("b.value")), 4).alias("gain"))  # one row by one row


def evidence_details(asked: DataFrame, registered: DataFrame, corpus: DataFrame, summaries: DataFrame) -> DataFrame:
    """asked(ordinal, evidence_id) from the registered spans, else the corpus, else the paper's whole summary."""
    out = asked.join(registered.select("evidence_id", F.col("text").alias("_a")), "evidence_id", "left").join(corpus.select("evidence_id", F.col("text").alias("_b")), "evidence_id", "left").join(summaries.select(F.col("paper_id").alias("evidence_id"), F.col("text").alias("_c")), "evidence_id", "left")
    place = F.when(F.col("_a").isNotNull(), "registered").when(F.col("_b").isNotNull(), "corpus").when(F.col("_c").isNotNull(), "summary")
    return out.select("ordinal", "evidence_id", place.alias("place"), F.coalesce("_a", "_b", "_c").alias("text")).where("place IS NOT NULL")


SALTS = 256


def mentioned(links: DataFrame, overlay: DataFrame, schema: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(entity, evidence_id, text) with mentioned: by a link, else by overlay aliases, which replace schema aliases where an entity has any, as substrings."""
    names = overlay.unionByName(schema.join(overlay.select("entity").distinct(), "entity", "left_anti"))
    names = names.groupBy("entity").agg(F.collect_set(F.lower("alias")).alias("_a"))  # of one entity
    # an entity may have a large share of the texts: they go to SALTS places, and its names to each of them
    names = names.select("entity", "_a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    texts = pairs.select("entity", "evidence_id", F.lower("text").alias("_low"), F.pmod(F.xxhash64("evidence_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    found = texts.join(names, ["entity", "_salt"]).where(F.exists("_a", lambda a: F.contains("_low", a))).select("entity", "evidence_id").distinct().withColumn("_n", F.lit(True))
    out = pairs.join(links.select("entity", "evidence_id").distinct().withColumn("_l", F.lit(True)), ["entity", "evidence_id"], "left").join(found, ["entity", "evidence_id"], "left")
    return out.select("entity", "evidence_id", F.coalesce("_l", "_n", F.lit(False)).alias("mentioned"))


def graph_context(papers: DataFrame, tokens: list[str], limit: int = 12) -> DataFrame:
    """papers(paper_id, text) that hold a token, or all of them where none does; the first `limit` by id."""
    low = F.lower("text")
    rows = papers.withColumn("_h", F.when(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(low, t)), 1).otherwise(0))
    best = rows.agg(F.max("_h").alias("_b"))
    return rows.join(F.broadcast(best), F.col("_h") == F.col("_b")).select("paper_id").orderBy("paper_id").limit(limit)


def capitalised(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Capitalised words inside sentences, folded and singular; those that begin a sentence don't count."""
    inner = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<=[^\s.!?。！？]\s)\s*([A-Z][A-Za-z0-9-]+)"), F.lit(1))
    kept = F.filter(F.transform(inner, lambda w: singular(w)), lambda w: (F.length(w) >= 2) & (~w.isin(*stop) if stop else F.lit(True)))
    return F.array_sort(F.array_distinct(kept))


def numbers(text: Column) -> Column:
    """Numbers as they are written."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*%?"), F.lit(0))))


def boundary_sentences(text: str) -> list[str]:
    """Cut after a mark that white space and a capital, digit or CJK sign follow; pieces that end in an abbreviation join the next."""
    out: list[str] = []
    for piece in re.split(r"(?<=[.!?。！？])\s+(?=[A-Z0-9一-鿿])", text.strip()):
        if out and re.search(r"\b(?:al|e\.g|i\.e|Fig|Eq|Dr|vs)\.$", out[-1]):
            out[-1] += " " + piece
        elif piece:
            out.append(piece)
    return out


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with size and the first 12 digits of their SHA-256."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), F.substring(F.sha2("content", 256), 1, 12).alias("sha256"))


def receipt(rows: DataFrame) -> DataFrame:
    """rows' count and an order-free digest, to be compared with a receipt made elsewhere.

    The digest is a sum of hashes, so repeated rows don't cancel each other.
    """
    each = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    h = F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def ledger(receipts: DataFrame) -> DataFrame:
    """receipts(run_id, generated_at, n, expected): invalid ones stay, marked; newest first."""
    valid = F.col("generated_at").isNotNull() & (F.col("n") == F.col("expected"))
    return receipts.select("run_id", "generated_at", F.when(valid, "valid").otherwise("invalid").alias("status")).orderBy(F.desc_nulls_last("generated_at"), "run_id")


def schema_faults(rows: DataFrame, required: dict[str, str]) -> DataFrame:
    """rows(id, body JSON) with the first required field whose JSON type differs, by name; '' for none."""

    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def first(bodies: pd.Series) -> pd.Series:
        import json

        kinds = {"string": str, "number": (int, float), "boolean": bool, "array": list, "object": dict}

        def fault(body: str) -> str:
            try:
                got = json.loads(body or "")
            except ValueError:
                return "not JSON"
            if not isinstance(got, dict):
                return "not an object"
            return next((k for k, kind in sorted(required.items()) if not isinstance(got.get(k), kinds[kind]) or kind == "number" and isinstance(got.get(k), bool)), "")

        return bodies.map(fault)

    return rows.select("id", first("body").alias("fault"))
