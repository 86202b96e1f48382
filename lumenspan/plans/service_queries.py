"""Catalogue, import and report queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import services as V
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT doc_id AS entry_id, 2015 + doc_id % 10 AS year, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'und', 'license', 'apache'])) AS BIGINT) AS score FROM documents) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, year DESC, entry_id LIMIT 40""")
def official_catalogue(spark, sf):
    """S13"""
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), "text", (2015 + F.col("doc_id") % 10).alias("year"))
    return V.catalogue_search(rows, ["the", "und", "license", "apache"], 40)


@query("""SELECT o_orderkey AS path_id, CASE WHEN o_orderkey % 3 = 0 THEN 'hard' WHEN o_custkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'easy' END AS verdict FROM orders""")
def labels_by_id_or_place(spark, sf):
    """J15"""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    named = o.where(k % 3 == 0).select(k.alias("path_id"), (-k).alias("position"), F.lit("hard").alias("verdict"))
    placed = o.where((F.col("o_custkey") % 2 == 0) & (k % 5 == 0)).select(F.lit(None).cast("long").alias("path_id"), k.alias("position"), F.lit("easy").alias("verdict"))
    return V.labels_for(o.select(k.alias("path_id"), k.alias("position")), named.unionByName(placed))


@query("""SELECT p_partkey AS relation_id, p_brand AS source FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) AND p_size >= 10 ORDER BY p_partkey LIMIT 4000""")
def import_from_store(spark, sf):
    """J19"""
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("relation_id"), F.col("p_brand").alias("source"), "p_size")
    links = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("relation_id"), F.col("o_custkey").alias("paper_id"))
    papers = load(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("paper_id"))
    return V.imported(p.where("p_size < 10").select("relation_id"), p.select("relation_id", "source"), links, papers, 4000)


@query("""WITH e AS (SELECT DISTINCT p_brand AS name, 'METHOD' AS kind FROM part WHERE p_size > 48), n AS (SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part) SELECT name, kind FROM e UNION ALL SELECT min(name), 'inferred' FROM n WHERE lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM e) GROUP BY lower(trim(name))""")
def inferred_entities(spark, sf):
    """J23"""
    p = load(spark, sf, "part")
    return V.with_missing_entities(p.where("p_size > 48").select(F.col("p_brand").alias("name"), F.lit("METHOD").alias("kind")).distinct(), p.select(F.col("p_brand").alias("source"), F.col("p_type").alias("target")))


@query("""SELECT user_id AS run_id, count(*) AS n_blocks, CASE WHEN bool_or(user_id % 5 = 0) THEN 'example_only' WHEN bool_and(value > 0.1) THEN 'passes' ELSE 'fails' END AS verdict FROM events GROUP BY 1""")
def report_verdicts(spark, sf):
    """A16"""
    return V.report_verdict(load(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("block"), (F.col("value") > 0.1).alias("passes"), (F.col("user_id") % 5 == 0).alias("example")))


@query("""WITH p AS (SELECT source AS topic, doc_id, CASE WHEN n_chars > 2000 THEN 'A' ELSE 'B' END AS g FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY g, doc_id) AS n FROM p)
SELECT topic, string_agg(doc_id, '|' ORDER BY n) FILTER (WHERE n <= 3) AS representatives, count(*) FILTER (WHERE g = 'A') AS n_a, count(*) FILTER (WHERE doc_id % 9 = 0) AS n_disputes, count(*) FILTER (WHERE doc_id % 11 = 0) AS n_gaps FROM r GROUP BY 1""")
def literature_map(spark, sf):
    """A30"""
    d = load(spark, sf, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("paper_id"), F.when(F.col("n_chars") > 2000, "A").otherwise("B").alias("grade"))
    return V.literature_map(d, d.where("paper_id % 9 = 0").select("topic"), d.where("paper_id % 11 = 0").select("topic"))


@query("""WITH t AS (SELECT conv_id, unnest(['the', 'une', 'ist', 'los']) AS term FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id AS case_id, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.conv_id AND role = 'assistant' AND contains(lower(text), term))) / 4, 6) AS coverage FROM t GROUP BY 1""")
def expected_term_coverage(spark, sf):
    """A40"""
    c = load(spark, sf, "conversations")
    cases = c.select(F.col("conv_id").alias("case_id")).distinct().withColumn("terms", F.array(*map(F.lit, ("the", "une", "ist", "los"))))
    return V.expected_terms(cases, c.select(F.col("conv_id").alias("case_id"), "text", F.when(F.col("role") == "assistant", "accepted").otherwise("rejected").alias("status")))


@query("""WITH v AS (SELECT event_type AS variant, avg(value) AS value FROM events GROUP BY 1), b AS (SELECT variant, value FROM v WHERE variant NOT IN ('view', 'signup') ORDER BY value DESC, variant DESC LIMIT 1) SELECT b.variant AS baseline, round(100 * (v.value - b.value), 4) AS gain FROM b, v WHERE v.variant = 'view'""")
def strongest_baseline(spark, sf):
    """A43"""
    v = load(spark, sf, "events").groupBy(F.col("event_type").alias("variant")).agg(F.avg("value").alias("value"))
    return V.strongest_baseline(v, "view", ("signup",))


@query("""SELECT doc_id AS ordinal, doc_id AS evidence_id, CASE WHEN doc_id % 4 = 0 THEN 'registered' WHEN doc_id % 3 = 0 THEN 'corpus' ELSE 'summary' END AS place, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 3 = 0 THEN source ELSE CAST(n_chars AS VARCHAR) END AS text FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0 OR doc_id % 2 = 0""")
def evidence_details(spark, sf):
    """W18, W19"""
    d, k = load(spark, sf, "documents"), F.col("doc_id")
    return V.evidence_details(d.select(k.alias("ordinal"), k.alias("evidence_id")), d.where(k % 4 == 0).select(k.alias("evidence_id"), F.col("lang").alias("text")), d.where(k % 3 == 0).select(k.alias("evidence_id"), F.col("source").alias("text")), d.where(k % 2 == 0).select(k.alias("paper_id"), F.col("n_chars").cast("string").alias("text")))


@query("""WITH p AS (SELECT 'e' || (doc_id % 4) AS entity, doc_id, text FROM documents) SELECT entity, doc_id AS evidence_id, doc_id % 7 = 0 OR CASE entity WHEN 'e0' THEN contains(lower(text), 'license') WHEN 'e1' THEN contains(lower(text), 'und') WHEN 'e2' THEN contains(lower(text), 'the') ELSE false END AS mentioned FROM p""")
def entity_mentioned(spark, sf):
    """W20"""
    d = load(spark, sf, "documents").select(F.concat(F.lit("e"), (F.col("doc_id") % 4).cast("string")).alias("entity"), F.col("doc_id").alias("evidence_id"), "text")
    overlay = spark.createDataFrame([("e0", "License")], "entity string, alias string")
    schema = spark.createDataFrame([("e0", "und"), ("e1", "und"), ("e2", "The")], "entity string, alias string")
    return V.mentioned(d.where("evidence_id % 7 = 0").select("entity", "evidence_id"), overlay, schema, d)


@query("""WITH h AS (SELECT doc_id, contains(lower(text), 'apache') OR contains(lower(text), 'mit license') AS h FROM documents) SELECT doc_id AS paper_id FROM h WHERE h = (SELECT bool_or(h) FROM h) ORDER BY doc_id LIMIT 12""")
def graph_context(spark, sf):
    """G07"""
    return V.graph_context(load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text"), ["apache", "mit license"])


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*%?'))), '|') AS numbers FROM documents""")
def evidence_numbers(spark, sf):
    """X07"""
    return load(spark, sf, "documents").select("doc_id", F.array_join(V.numbers(F.col("text")), "|").alias("numbers"))


@query("""SELECT user_id AS run_id, max(event_id) AS generated_at, CASE WHEN count(*) % 2 = 0 AND max(event_id) IS NOT NULL THEN 'valid' ELSE 'invalid' END AS status FROM events GROUP BY 1""")
def run_ledger(spark, sf):
    """S23"""
    g = load(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("event_id").alias("generated_at"), F.count("*").alias("n"))
    return V.ledger(g.withColumn("expected", F.col("n") - F.col("n") % 2))


@query("""SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}'), 1, 15) AS BIGINT)) AS VARCHAR) AS digest, true AS same FROM labels""")
def receipt_check(spark, sf):
    """The receipt of a table, and whether one made again from differently dealt rows is the same"""
    rows = load(spark, sf, "labels").select("doc_id", "quality", "toxic")
    a, b = V.receipt(rows), V.receipt(rows.repartition(5))
    return a.join(b.select(F.col("digest").alias("d"), F.col("n").alias("m")), F.col("n") == F.col("m")).select("n", "digest", (F.col("digest") == F.col("d")).alias("same"))
