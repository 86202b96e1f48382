"""Sources and sinks (S rows): JSON, JSONL, Markdown, JATS, inverted abstracts, CSV and JSON exports, graph stores."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.session import ship

PAPERS = "paper_id string, title string, authors array<string>, year int, published string, categories array<string>, summary string, concepts array<string>, source_url string, source_type string, publisher string, authority_tier int, license string, retrieved_at string, content_hash string, external_ids map<string,string>"
BENCHMARK = "case_id string, profile_id string, query string, expected_terms array<string>, domain string, synthetic boolean"
STORE = ("papers", "sections", "evidence", "entities", "relations", "relation_evidence")


def json_array(spark: SparkSession, path: str, schema: str = PAPERS) -> DataFrame:
    """A JSON array of records."""
    return spark.read.json(path, schema=schema, multiLine=True)


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a broken line fails, and so does a row without a required field or that isn't synthetic."""
    rows = spark.read.json(path, schema=BENCHMARK, mode="FAILFAST")
    bad = F.col("case_id").isNull() | F.col("query").isNull() | F.col("expected_terms").isNull() | ~F.coalesce("synthetic", F.lit(False))
    return rows.withColumn("case_id", F.when(bad, F.raise_error(F.lit("a benchmark row lacks a field or is not synthetic"))).otherwise(F.col("case_id")))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """docs(paper_id, text) to (paper_id, section_id, text): lines go to the last heading before them.

    The first heading is the title; equal headings join; sections without text are dropped.
    """
    lines = docs.select("paper_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    heading = F.regexp_extract("line", r"^ {0,3}#{1,6}\s+(.+?)\s*$", 1)
    order = Window.partitionBy("paper_id").orderBy("n")
    rows = lines.withColumn("h", F.when(heading != "", heading)).withColumn("k", F.count("h").over(order))
    name = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.last("h", True).over(order)), r"[\s_\-/]+", " ")), " ", "-")
    rows = rows.withColumn("section_id", F.when(F.col("k") == 0, "body").when(F.col("k") == 1, "title").otherwise(name))
    text = F.when((F.col("k") == 1) & F.col("h").isNotNull(), F.col("h")).when(F.col("h").isNull(), F.trim("line"))
    parts = rows.withColumn("t", text).where("t IS NOT NULL AND t <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n")
    return parts.groupBy("paper_id", "section_id").agg(F.min("n").alias("section_ord"), joined.alias("text"))


def jats_pages(document: str) -> list[dict]:
    """Pages of a JATS article: what precedes the sections, then each top-level section; <back> is left out."""
    root = ElementTree.fromstring(document)
    local = lambda e: e.tag.rpartition("}")[2]
    body = next((e for e in root.iter() if local(e) == "body"), None)
    if body is None:
        raise ValueError("the article has no body")
    text = lambda e: " ".join(" ".join(e.itertext()).split())
    pages, before = [], []
    for child in body:
        if local(child) == "sec":
            pages.append(text(child))
        elif not pages:
            before.append(text(child))
    pages = [p for p in [" ".join(before), *pages] if p]
    if not pages:
        raise ValueError("the article's body is empty")
    return [{"section_id": f"page-{k:03d}", "text": p} for k, p in enumerate(pages, 1)]


def jats_sections(docs: DataFrame) -> DataFrame:
    """docs(paper_id, xml) to (paper_id, section_id, text)."""

    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<section_id:string,text:string>>")
    def pages(xml: pd.Series) -> pd.Series:
        return xml.map(jats_pages)

    return docs.select("paper_id", F.explode(pages("xml")).alias("p")).select("paper_id", "p.section_id", "p.text")


def html_sections(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) to (page_id, section_ord, heading, text): the parts that begin at each h1 to h6, by pattern."""
    parts = F.split(F.coalesce("html", F.lit("")), "(?i)(?=<h[1-6][ >])")
    rows = pages.select("page_id", F.posexplode(parts).alias("section_ord", "part"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    heading = clean(F.regexp_extract("part", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1))
    body = clean(F.regexp_replace("part", r"(?is)^<h[1-6][^>]*>.*?</h[1-6]>", " "))
    return rows.select("page_id", "section_ord", heading.alias("heading"), body.alias("text")).where("heading <> '' OR text <> ''")


def index_of(words: Column) -> Column:
    """The inverted index of a text's words, map<word, array<position>>, made inside its row."""

    def grouped(placed: Column, firsts: Column) -> Column:
        size = lambda at, k: F.coalesce(F.get(firsts, k + 1), F.size(placed)) - at
        return F.transform(firsts, lambda at, k: F.struct(F.get(placed, at)["w"].alias("key"), F.transform(F.slice(placed, at + 1, size(at, k)), lambda x: x["p"]).alias("value")))

    def of(placed: Column) -> Column:
        begins = F.filter(F.transform(placed, lambda x, i: F.when((i == 0) | (x["w"] != F.get(placed, i - 1)["w"]), i)), lambda i: i.isNotNull())
        return F.transform(F.array(begins), lambda firsts: grouped(placed, firsts))[0]

    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    return F.map_from_entries(F.transform(F.array(placed), of)[0])


def abstract_of(index: str) -> Column:
    """The text of an inverted index, map<word, array<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def write_store(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """The graph store's tables, overwritten, and their row counts."""
    out = {}
    for name in STORE:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = tables[name].sparkSession.read.parquet(f"{path}/{name}").count()
    return out


def export_csv(relations: DataFrame, path: str) -> None:
    """Relations with evidence_ids joined by |."""
    relations.withColumn("evidence_ids", F.array_join("evidence_ids", "|")).write.mode("overwrite").csv(path, header=True)


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def finite_metrics(rows: DataFrame, key: str) -> DataFrame:
    """(name, value) of the finite numbers, named key.column."""
    numbers = [f.name for f in rows.schema if f.name != key and f.dataType.typeName() in ("double", "float", "integer", "long")]
    long = rows.select(key, *(F.col(c).cast("double").alias(c) for c in numbers)).unpivot([key], numbers, "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select(F.concat_ws(".", key, "metric").alias("name"), "value")
