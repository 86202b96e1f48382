"""Evidence spans, mentions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import sentence_spans, sentences, stable_id
from lumenspan.operators.components import connected_components
from lumenspan.operators.mentions import located
from lumenspan.session import ship


def evidence_spans(sections: DataFrame) -> DataFrame:
    """sections(paper_id, section_id, text) to spans with offsets into the section (splitter X13)."""
    ship(sections.sparkSession)
    rows = sections.select("paper_id", "section_id", F.posexplode(sentence_spans("text")).alias("sentence_index", "s"))
    section = F.substring(F.sha1(F.col("section_id").cast("binary")), 1, 14)
    key = F.concat(F.lit("evidence:"), F.col("paper_id").cast("string"), F.lit(":"), section, F.lit(":"), F.col("sentence_index").cast("string"))
    return rows.select(key.alias("evidence_id"), "paper_id", "section_id", "sentence_index", "s.text", "s.char_start", "s.char_end")


def plain_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(paper_id, sentence_index, text) by the plain splitter, in built-in functions alone."""
    return docs.select(F.col(key).alias("paper_id"), F.posexplode(sentences(F.col("text"))).alias("sentence_index", "text"))


def mentions(spans: DataFrame, dictionary, boundary: str = "ascii") -> DataFrame:
    """Greedy dictionary mentions with offsets into the sentence, one row each; dictionary as for `located`."""
    rows = located(spans.select("evidence_id", "paper_id", "text"), dictionary, boundary=boundary)
    rows = rows.select("evidence_id", "paper_id", F.explode("mentions").alias("m"))
    key = stable_id("mention", F.col("evidence_id").cast("string"), F.col("m.concept"), F.col("m.char_start").cast("string"), F.col("m.char_end").cast("string"))
    return rows.select(key.alias("mention_id"), "evidence_id", "paper_id", "m.concept", "m.type", "m.char_start", "m.char_end")


def first_mentions(found: DataFrame) -> DataFrame:
    """The first mention of each concept in each sentence."""
    order = Window.partitionBy("evidence_id", "concept").orderBy("char_start")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def entities(found: DataFrame) -> DataFrame:
    """Concept, distinct evidence, confidence min(.99, .78 + .04 (n - 1))."""
    out = found.groupBy("concept").agg(F.countDistinct("evidence_id").alias("n_evidence"))
    return out.withColumn("confidence", F.round(F.least(F.lit(0.99), 0.78 + 0.04 * (F.col("n_evidence") - 1)), 6))


def cooccurrence(found: DataFrame, triggered: DataFrame) -> DataFrame:
    """Relations (source, target, type) between concepts of a sentence, by order of first mention.

    triggered(evidence_id, type) gives a sentence's relation type; RELATED_TO without one. Confidence is
    min(.96, base + .03 n (n - 1) / 2) with base .78 for triggered and .62 for others, n distinct spans.
    """
    once = first_mentions(found).select("evidence_id", "concept", "char_start")
    left, right = once.select("evidence_id", F.col("concept").alias("source"), F.col("char_start").alias("_a")), once.select("evidence_id", F.col("concept").alias("target"), F.col("char_start").alias("_b"))
    pairs = left.join(right, "evidence_id").where("_a < _b").join(triggered, "evidence_id", "left")
    out = pairs.groupBy("source", "target", F.coalesce("type", F.lit("RELATED_TO")).alias("type")).agg(F.countDistinct("evidence_id").alias("n_evidence"))
    base = F.when(F.col("type") == "RELATED_TO", 0.62).otherwise(0.78)
    return out.withColumn("confidence", F.round(F.least(F.lit(0.96), base + 0.03 * F.col("n_evidence") * (F.col("n_evidence") - 1) / 2), 6))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community): components of accepted edges(src, dst); lone nodes are communities of their own."""
    found = connected_components(edges).withColumnRenamed("node", "_node")
    return nodes.join(found, nodes["node"] == found["_node"], "left").select("node", F.coalesce("component", "node").alias("community"))


def audit(spans: DataFrame, found: DataFrame) -> DataFrame:
    """Spans, spans with a mention, mentions, coverage (1.0 when there are no spans)."""
    hit = found.select("evidence_id").distinct()
    rows = spans.join(hit.withColumn("_h", F.lit(1)), "evidence_id", "left").agg(F.count("*").alias("n_spans"), F.count("_h").alias("n_hit"))
    return rows.withColumn("coverage", F.round(F.when(F.col("n_spans") > 0, F.col("n_hit") / F.col("n_spans")).otherwise(1.0), 6))


def reference_regions(sections: DataFrame) -> DataFrame:
    """sections(paper_id, section_id, n_sentences, n_citations, has_heading, parser) with is_reference.

    A heading counts on any page; a page of 5 or more sentences with a share of .6 citations counts in the
    last third, where `page-nnn` names and the paper's last page tell. JATS documents are never judged.
    """
    page = F.when(F.col("section_id").rlike("^page-[0-9]+$"), F.regexp_extract("section_id", "([0-9]+)$", 1).cast("int"))
    rows = sections.withColumn("page", page).withColumn("_last", F.max("page").over(Window.partitionBy("paper_id")))
    late = F.col("page") >= F.greatest(F.lit(1), F.ceil(F.col("_last") * 2 / 3))
    layout = (F.col("n_sentences") >= 5) & (F.col("n_citations") >= 0.6 * F.col("n_sentences")) & F.coalesce(late, F.lit(False))
    return rows.withColumn("is_reference", ~F.coalesce("parser", F.lit("")).startswith("jats-xml") & (F.col("has_heading") | layout)).drop("_last")
