"""Tolerant readers and the store by domain over files that Spark makes from the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.session import load, shared_dir
from lumenspan.sources import files as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH c AS (SELECT * FROM conversations), bad AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'broken' WHEN conv_id % 11 = 0 THEN 'no_domain' END AS fault FROM c)
SELECT conv_id, NULL AS paper_id, fault AS status FROM bad WHERE fault IS NOT NULL
UNION ALL SELECT conv_id, CASE WHEN turn % 5 <> 4 THEN 'p' || turn END, CASE WHEN turn % 5 = 4 THEN 'no_id' WHEN turn % 3 = 2 THEN 'outside_root' WHEN role = 'user' THEN 'metadata_only' ELSE 'ok' END FROM c JOIN bad USING (conv_id) WHERE fault IS NULL""")
def corpus_papers(spark, sf):
    """Papers of manifests (a conversation each), some broken, without a domain, or with documents outside their root"""
    turn = F.col("turn")
    place = F.when(turn % 3 == 2, F.when(turn % 2 == 0, "docs/../../x.md").otherwise("/etc/x.md")).otherwise("docs/../x.md")
    paper = F.struct(F.when(turn % 5 != 4, F.concat(F.lit("p"), turn)).alias("paper_id"), F.col("text").alias("title"), place.alias("document_path"), (F.col("role") == "user").alias("exclude_from_evidence_graph"))
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(paper).alias("papers"))  # the turns of one conversation
    value = F.to_json(F.struct(F.when(F.col("conv_id") % 11 != 0, F.lit("d")).alias("domain_id"), F.lit("name").alias("domain_name"), F.lit("1").alias("version"), "papers"))
    files = c.select(F.col("conv_id").cast("string").alias("path"), F.when(F.col("conv_id") % 7 == 0, F.substring(value, 1, 40)).otherwise(value).alias("value"))
    return S.manifests(files).select(F.col("path").cast("long").alias("conv_id"), "paper_id", "status")


@query("""SELECT 'out/e' || (o_custkey % 5) || '/r' || o_orderkey AS run, CASE WHEN ok AND o_orderkey % 4 <> 0 THEN 's' || o_custkey ELSE 'e' || (o_custkey % 5) END AS experiment, CASE WHEN ok THEN strftime(o_orderdate, '%Y-%m-%d') END AS generated_at,
CASE WHEN ok THEN CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderstatus END ELSE 'invalid' END AS status, CASE WHEN ok THEN (o_orderkey % 3)::INTEGER END AS n_summary,
CASE o_orderkey % 10 WHEN 1 THEN 'receipt' WHEN 2 THEN 'config' WHEN 3 THEN 'config' WHEN 4 THEN 'summary' END AS error FROM (SELECT *, o_orderkey % 10 NOT IN (1, 2, 3, 4) AS ok FROM orders)""")
def run_ledger_files(spark, sf):
    """Receipts, configs and summaries (an order each), some broken or missing"""
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    run = F.concat(F.lit("out/e"), F.col("o_custkey") % 5, F.lit("/r"), k)
    file = lambda name, value, some=F.lit(True): o.where(some).select(F.concat(run, F.lit(f"/{name}.json")).alias("path"), value.alias("value"))
    receipt = F.when(k % 10 == 1, "[1, 2]").otherwise(F.to_json(F.struct(F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"))))
    config = F.when(k % 10 == 2, "{broken").otherwise(F.to_json(F.struct(F.when(k % 4 != 0, F.concat(F.lit("s"), "o_custkey")).alias("slug"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("generated_at"))))
    summary = F.when(k % 10 == 4, "{}").otherwise(F.to_json(F.slice(F.array(F.lit("a"), F.lit("b")), 1, (k % 3).cast("int"))))
    rows = S.ledger(file("verification", receipt), file("run_config", config, k % 10 != 3), file("summary", summary))
    return rows.select("run", "experiment", "generated_at", "status", "n_summary", "error")


@query("""SELECT lang AS domain, source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1, 2""")
def domain_scan(spark, sf):
    """One domain of a partitioned store, read from its folder alone"""
    root = shared_dir(spark)
    S.write_domains({"papers": load(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("domain"))}, root)
    return S.scan_domain(spark, root, "papers", "doc_id long, source string", "de").groupBy("domain", "source").agg(F.count("*").alias("n"))
