"""Summaries and record mappers over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import metrics as M
from lumenspan.operators import summaries as S
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _interval(name: str, k: str, n: str) -> str:
    p, z = f"({k} / {n})", str(M.Z_ABLATION)
    middle, spread = f"({p} + {z} * {z} / (2 * {n}))", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))"
    edge = lambda sign, bound: f"CASE WHEN {n} > 0 THEN round({bound}(({middle} {sign} {spread}) / (1 + {z} * {z} / {n}), {0 if sign == '-' else 1}), 3) ELSE 0 END"
    return f"round(coalesce({k} / nullif({n}, 0), 0), 3)::DOUBLE AS {name}, {edge('-', 'greatest')}::DOUBLE AS {name}_low, {edge('+', 'least')}::DOUBLE AS {name}_high"


@query(f"""WITH d AS (SELECT o_orderkey AS claim_id, 'v' || (o_custkey % 3) AS variant, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'needs_review' ELSE 'rejected' END AS status, o_orderkey % 4 > 0 AS gold FROM orders),
e AS (SELECT l_orderkey AS claim_id, l_suppkey AS paper_id, l_quantity < 45 AS valid FROM lineitem), w AS (SELECT claim_id, bool_and(valid) AS whole FROM e GROUP BY 1),
n AS (SELECT variant, count(*) FILTER (WHERE status = 'accepted') AS n_accepted, count(*) FILTER (WHERE status = 'needs_review') AS n_review, count(*) FILTER (WHERE status = 'rejected') AS n_rejected, count(*) FILTER (WHERE gold) AS n_supported, count(*) FILTER (WHERE NOT gold) AS n_unsupported,
 count(*) FILTER (WHERE status = 'accepted' AND gold) AS tp, count(*) FILTER (WHERE status = 'accepted' AND NOT gold) AS fp, count(*) FILTER (WHERE status <> 'accepted' AND gold) AS fn, count(*) FILTER (WHERE status = 'accepted' AND whole) AS n_complete FROM d LEFT JOIN w USING (claim_id) GROUP BY 1),
p AS (SELECT variant, count(DISTINCT paper_id) AS n_papers FROM d JOIN e USING (claim_id) WHERE status = 'accepted' AND gold GROUP BY 1), x AS (SELECT n.*, coalesce(n_papers, 0) AS n_papers FROM n LEFT JOIN p USING (variant))
SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3)::DOUBLE AS f1, round(coalesce(tp / nullif(n_papers, 0), 0), 3)::DOUBLE AS yield_per_paper, {_interval("precision", "tp", "(tp + fp)")}, {_interval("recall", "tp", "n_supported")}, {_interval("unsupported_rate", "fp", "n_unsupported")}, {_interval("coverage", "n_complete", "n_accepted")} FROM x""")
def variant_report(spark, sf):
    """Decision variants with unsupported acceptance, coverage, yield and intervals"""
    o = load(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("rejected")
    decisions = o.select(F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("v"), F.col("o_custkey") % 3).alias("variant"), status.alias("status"), (F.col("o_orderkey") % 4 > 0).alias("gold"))
    return S.variant_report(decisions, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("paper_id"), (F.col("l_quantity") < 45).alias("valid")))


FREQUENCY = "f AS (SELECT l_partkey AS concept, count(DISTINCT l_suppkey) AS raw_df, count(DISTINCT l_suppkey % 40) AS independent_df FROM lineitem GROUP BY 1), g AS (SELECT *, raw_df - independent_df AS duplicate_df FROM f)"


def _frequency(spark, sf):
    out = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("concept")).agg(F.countDistinct("l_suppkey").alias("raw_df"), F.countDistinct(F.col("l_suppkey") % 40).alias("independent_df"))
    return out.withColumn("duplicate_df", F.col("raw_df") - F.col("independent_df"))


@query(f"""WITH {FREQUENCY} SELECT count(*) AS n_concepts, count(*) FILTER (WHERE raw_df > 0) AS n_hit, count(*) FILTER (WHERE duplicate_df > 0) AS n_drop, sum(raw_df)::BIGINT AS raw_total, sum(independent_df)::BIGINT AS independent_total, max(duplicate_df)::BIGINT AS max_drop, round((sum(raw_df) - sum(independent_df)) / sum(raw_df), 6)::DOUBLE AS drop_ratio FROM g""")
def frequency_report(spark, sf):
    """Document frequencies with copies and without, in all"""
    return S.frequency_report(_frequency(spark, sf))


@query(f"WITH {FREQUENCY} SELECT duplicate_df, count(*) AS n_concepts FROM g GROUP BY 1")
def drop_distribution(spark, sf):
    """The histogram of what copies take away"""
    return S.drop_distribution(_frequency(spark, sf))


def _members(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") * 3 + F.length("c_name") % 3).alias("community"))


@query("""WITH m AS (SELECT c_custkey AS node, c_nationkey * 3 + length(c_name) % 3 AS community FROM customer) SELECT community, count(*) AS size, count(*) FILTER (WHERE node % 11 = 0) AS n_matched, round(count(*) FILTER (WHERE node % 11 = 0) / count(*), 3)::DOUBLE AS score FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE node % 11 = 0) > 0 ORDER BY 3 DESC, 4 DESC, 2 DESC, 1 LIMIT 10""")
def matched_communities(spark, sf):
    """Communities by what they share with chosen nodes"""
    m = _members(spark, sf)
    return S.matched_communities(m, m.where("node % 11 = 0").select("node"), 10)


@query("""SELECT c_nationkey * 3 + length(c_name) % 3 AS community, count(*) AS size FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def largest_communities(spark, sf):
    """The largest communities"""
    return S.largest_communities(_members(spark, sf), 10)


@query("""WITH c AS (SELECT l_orderkey AS run_id, count(*) FILTER (WHERE l_returnflag = 'N') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity::INT % 4 = 0) AS bare FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS run_id, o_custkey % 9 AS t, o_orderkey % 7 AS e, CASE WHEN o_orderkey % 5 > 0 THEN ['alpha', 'BETA' || (o_orderkey % 3)] ELSE [] END AS req, lower('Alpha beta1 gamma' || (o_custkey % 2)) AS cov FROM orders)
SELECT o.run_id, round(CASE WHEN coalesce(a, 0) > 0 THEN 100 * bare / a ELSE 100 END, 1)::DOUBLE AS unsupported_rate, greatest(0, 100 - 20 * abs(t - e))::DOUBLE AS adaptation, round(CASE WHEN len(req) > 0 THEN 100 * len(list_filter(req, lambda x: contains(cov, lower(x)))) / len(req) ELSE 100 END, 1)::DOUBLE AS coverage, coalesce(a, 0) AS n_accepted, coalesce(r, 0) AS n_rejected FROM o LEFT JOIN c USING (run_id)""")
def run_proxies(spark, sf):
    """Proxies of a run in percent"""
    k = F.col("o_orderkey")
    runs = load(spark, sf, "orders").select(k.alias("run_id"), (F.col("o_custkey") % 9).alias("target"), (k % 7).alias("expected"), F.when(k % 5 > 0, F.array(F.lit("alpha"), F.concat(F.lit("BETA"), k % 3))).otherwise(F.array().cast("array<string>")).alias("required"), F.array(F.lit("Alpha beta1"), F.concat(F.lit("gamma"), F.col("o_custkey") % 2)).alias("covered"))
    flag = F.col("l_returnflag")
    claims = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(flag == "N", "accepted").when(flag == "R", "rejected").otherwise("needs_review").alias("status"), (F.round("l_quantity").cast("int") % 4).alias("n_evidence"))
    return S.run_proxies(runs, claims)


@query("""SELECT o_orderkey AS panel_id, count(l_orderkey) AS n_processed, count(*) FILTER (WHERE l_returnflag = 'N') AS n_accepted, count(*) FILTER (WHERE l_returnflag = 'A') AS n_needs_review, count(*) FILTER (WHERE l_returnflag = 'R') AS n_rejected, greatest(0, any_value(o_custkey % 9) - count(l_orderkey)) AS n_remaining FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def panel_counts(spark, sf):
    """What a panel accepted, left and rejected, and what remains"""
    flag = F.col("l_returnflag")
    verdicts = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("panel_id"), F.when(flag == "N", "accepted").when(flag == "R", "rejected").otherwise("needs_review").alias("status"))
    return S.panel_counts(load(spark, sf, "orders").select(F.col("o_orderkey").alias("panel_id"), (F.col("o_custkey") % 9).alias("n_available")), verdicts)


@query("""SELECT lang AS domain, count(*) AS n_papers, count(*) FILTER (WHERE doc_id % 5 > 0) AS n_evidence_papers, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_metadata_only, count(DISTINCT source) AS n_entity, count(DISTINCT n_chars) AS n_relation FROM documents GROUP BY 1""")
def domain_atlas(spark, sf):
    """Papers, entities and relations of each domain"""
    d = load(spark, sf, "documents").withColumnRenamed("lang", "domain")
    return S.atlas(d.select("domain", (F.col("doc_id") % 5 == 0).alias("metadata_only")), d.select("domain", F.col("source").alias("entity_id")), d.select("domain", F.col("n_chars").alias("relation_id")))


@query("""WITH d AS (SELECT *, '10.1/' || lower(CASE WHEN doc_id % 6 = 0 THEN 'A' || (doc_id % 20) ELSE 'X' || doc_id END) AS doi, substr(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), 1, 60) AS t FROM documents WHERE doc_id % 7 > 0),
o AS (SELECT doi, arg_min(doc_id, lpad(doc_id::VARCHAR, 9, '0')) AS doc_id FROM d GROUP BY 1)
SELECT 'doi:' || doi AS paper_id, 'T' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Ann Lee|Kim' END AS authors, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2000 + doc_id % 25 END::INTEGER AS year, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE (2000 + doc_id % 25) || '-7' END AS published,
 CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE 'Big & small ' || doc_id END AS summary, CASE WHEN doc_id % 5 = 0 THEN 'https://doi.org/' || doi ELSE 'http://x/' || doc_id END AS source_url, CASE WHEN doc_id % 8 = 0 THEN 'Crossref member' ELSE source END AS publisher FROM o JOIN documents USING (doc_id)""")
def crossref_records(spark, sf):
    """Records of a register of DOIs as papers"""
    k = F.col("doc_id")
    doi = F.when(k % 7 > 0, F.concat(F.lit("10.1/"), F.when(k % 6 == 0, F.concat(F.lit("A"), k % 20)).otherwise(F.concat(F.lit("X"), k))))
    person = lambda given, family: F.struct(F.lit(given).cast("string").alias("given"), F.lit(family).alias("family"))
    record = F.struct(
        F.lpad(k.cast("string"), 9, "0").alias("A"), doi.alias("DOI"), F.array(F.concat(F.lit("T"), k)).alias("title"), F.when(k % 2 > 0, F.concat(F.lit("<p>Big &amp; <i>small</i> "), k, F.lit("</p>"))).alias("abstract"),
        F.when(k % 3 > 0, F.struct(F.array(F.array(2000 + k % 25, F.lit(7))).alias("date-parts"))).alias("published"), F.when(k % 4 > 0, F.array(person("Ann", "Lee"), person(None, "Kim"))).alias("author"),
        F.when(k % 5 > 0, F.concat(F.lit("http://x/"), k)).alias("URL"), F.when(k % 8 > 0, F.col("source")).alias("publisher"))
    rows = S.crossref_papers(load(spark, sf, "documents").select(F.to_json(record).alias("value")))
    return rows.select("paper_id", "title", F.array_join("authors", "|").alias("authors"), "year", "published", "summary", "source_url", "publisher")


@query("""SELECT 's2:p' || doc_id AS paper_id, 'T' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Ann Lee' END AS authors, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2000 + doc_id % 25 END::INTEGER AS year, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE 'Abstract ' || doc_id END AS summary,
 CASE WHEN doc_id % 5 = 0 THEN 'http://pdf' WHEN doc_id % 5 = 1 THEN '' ELSE 'http://page' END AS source_url, CASE WHEN doc_id % 5 = 0 THEN 'GREEN' ELSE 'metadata-only' END AS license, CASE WHEN doc_id % 6 = 0 THEN '10.1/abc' ELSE '' END AS doi FROM documents WHERE doc_id % 7 > 0""")
def scholar_records(spark, sf):
    """Records of a scholarly graph as papers"""
    k = F.col("doc_id")
    record = F.struct(
        F.when(k % 7 > 0, F.concat(F.lit("p"), k)).alias("paperId"), F.concat(F.lit("T"), k).alias("title"), F.when(k % 2 > 0, F.concat(F.lit("Abstract "), k)).alias("abstract"), F.when(k % 3 > 0, 2000 + k % 25).alias("year"), F.when(k % 5 > 1, "http://page").alias("url"),
        F.when(k % 6 == 0, F.struct(F.lit("10.1/ABC").alias("DOI"))).alias("externalIds"), F.when(k % 5 == 0, F.struct(F.lit("http://pdf").alias("url"), F.lit("GREEN").alias("status"))).alias("openAccessPdf"), F.when(k % 4 > 0, F.array(F.struct(F.lit("Ann Lee").alias("name")), F.struct(F.lit("").alias("name")))).alias("authors"))
    rows = S.scholar_papers(load(spark, sf, "documents").select(F.to_json(record).alias("value")))
    return rows.select("paper_id", "title", F.array_join("authors", "|").alias("authors"), "year", "summary", "source_url", "license", "doi")


ASKED = ("the stupid river", "report and that")


def _federation(spark, sf):
    from lumenspan.operators import federation as N

    d, k = load(spark, sf, "documents"), F.col("doc_id")
    rows = d.select(
        k.cast("string").alias("paper_id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("summary"), F.array(F.col("source"), F.when(k % 50 == 0, "report river").otherwise("")).alias("concepts"),
        F.when(k % 4 == 0, F.concat(F.lit("10.1000/"), (F.col("n_chars") % 97).cast("string"))).otherwise("").alias("doi"), F.when(k % 4 == 1, F.concat(F.lit("https://X.org/"), (F.col("n_chars") % 89).cast("string"), F.lit("/"))).otherwise("").alias("url"),
        (k % 30 + 1).cast("int").alias("tier"), (2000 + k % 25).cast("int").alias("year"), "lang")
    sources = {name: rows.where(F.col("lang") == name) for name in ("en", "de", "fr")} | {"es": None}
    return N.search(spark, sources, list(ASKED), 25)


_WORDS = ("the", "stupid", "river", "report", "and", "that")
FEDERATION = f"""p AS (SELECT doc_id::VARCHAR AS paper_id, lang AS source, (doc_id % 30 + 1)::INTEGER AS tier, (2000 + doc_id % 25)::INTEGER AS year, lower(substr(coalesce(text, ''), 1, 40)) AS title, lower(coalesce(substr(text, 1, 40), '') || ' ' || coalesce(text, '') || ' ' || source || ' ' || CASE WHEN doc_id % 50 = 0 THEN 'report river' ELSE '' END) AS low, length(coalesce(text, '')) AS n,
 CASE WHEN doc_id % 4 = 0 THEN '10.1000/' || (n_chars % 97) WHEN doc_id % 4 = 1 THEN 'https://x.org/' || (n_chars % 89) ELSE doc_id::VARCHAR END AS k FROM documents WHERE lang IN ('en', 'de', 'fr')),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, n DESC, paper_id) = 1)"""


@query(f"""WITH {FEDERATION} SELECT paper_id, source, tier, year, (tier = 1)::INTEGER AS official, round({" + ".join(f"CASE WHEN contains(title, '{w}') THEN 3 WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in _WORDS)} + greatest(0, 4 - tier) * 2 + least(2.0, n / 500), 6)::DOUBLE AS score FROM d
WHERE tier = 1 OR {" + ".join(f"contains(low, '{w}')::INT" for w in _WORDS if w not in ("and", "the"))} >= 2 ORDER BY official DESC, score DESC, year DESC, paper_id LIMIT 25""")
def federated_search(spark, sf):
    """The best papers of several sources together (the top 25 are the report), one of which gave nothing"""
    return _federation(spark, sf)[0]


@query("""SELECT s AS source, s <> 'es' AS successful, CASE WHEN s = 'es' THEN 0 ELSE (SELECT count(*) FROM documents WHERE lang = s) END AS n_found FROM (SELECT unnest(['en', 'de', 'fr', 'es']) AS s)""")
def federation_report(spark, sf):
    """Which sources were asked, which answered, and with how many papers"""
    return _federation(spark, sf)[1]
