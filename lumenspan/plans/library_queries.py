"""Library queries over the driver's tables, each with its SQL.

Mapping (ours): customer is a paper and its nation the domain; orders are evidence spans, lineitem the links
between spans and relations, part the relations; events are decisions of users.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import library as L
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def papers(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("domain_id"), F.col("c_mktsegment").alias("publisher"), F.col("c_acctbal").alias("balance"))


def evidence(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("paper_id"), (F.col("o_orderkey") % 1000).alias("char_start"))


def links(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_partkey").alias("relation_id"), F.col("l_orderkey").alias("evidence_id"))


def relations(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("relation_id"), F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.col("p_size").alias("size"))


@query("""SELECT c_custkey AS paper_id, coalesce(e.n, 0) AS evidence_count, coalesce(r.n, 0) AS relation_count FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) e ON e.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) r ON r.o_custkey = c_custkey""")
def paper_evidence_relation_counts(spark, sf):
    """A02, J01"""
    return L.paper_counts(papers(spark, sf), evidence(spark, sf), links(spark, sf))


@query("""SELECT p_partkey AS relation_id, p_brand AS source, p_type AS target, p_size AS size FROM part WHERE p_partkey IN (
SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)""")
def relations_for_papers(spark, sf):
    """Relations with evidence in the papers of one domain"""
    return L.relations_of(relations(spark, sf), links(spark, sf), evidence(spark, sf), papers(spark, sf).where("domain_id = 3"))


@query("""SELECT l_partkey AS relation_id, count(*) AS n_spans, string_agg(o_custkey || ':' || o_orderkey, '|' ORDER BY o_custkey, o_orderkey % 1000, o_orderkey) AS spans
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_evidence(spark, sf):
    """Spans nested under their relation, in order"""
    rows = L.nested_evidence(links(spark, sf), evidence(spark, sf))
    return rows.select("relation_id", F.size("evidence").cast("long").alias("n_spans"), F.array_join(F.transform("evidence", lambda e: F.concat(e["paper_id"].cast("string"), F.lit(":"), e["evidence_id"].cast("string"))), "|").alias("spans"))


@query("""SELECT domain_id, paper_id, title, balance FROM (SELECT c_nationkey AS domain_id, c_custkey AS paper_id, c_name AS title, c_acctbal AS balance, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_mktsegment, c_name, c_custkey) AS n FROM customer) WHERE n <= 100""")
def slice_papers(spark, sf):
    """The hundred first papers of each domain by a four-key order"""
    return L.top(papers(spark, sf), [F.desc("balance"), F.col("publisher"), F.col("title"), F.col("paper_id")], 100, by=["domain_id"]).select("domain_id", "paper_id", "title", "balance")


@query("""SELECT n_nationkey AS domain_id, count(DISTINCT o_custkey) AS n_members, CAST(coalesce(sum(o_orderkey % 10), 0) AS BIGINT) AS total FROM nation
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def slice_summary(spark, sf):
    """Distinct papers and retrievals by domain, 0 without any"""
    rows = load(spark, sf, "nation").select(F.col("n_nationkey").alias("domain_id")).join(papers(spark, sf), "domain_id", "left")
    held = evidence(spark, sf).select("paper_id", F.col("paper_id").alias("held"), (F.col("evidence_id") % 10).alias("retrievals"))
    return L.grouped_total(rows.join(held, "paper_id", "left"), ["domain_id"], "held", "retrievals")


@query("""SELECT c_custkey AS paper_id, count(DISTINCT o_orderkey) AS n_evidence, count(DISTINCT l_partkey) AS n_relations FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def history_fanout(spark, sf):
    """Two left joins with two distinct counts; the fan-out is counted before it meets"""
    e = evidence(spark, sf)
    per = e.join(links(spark, sf), "evidence_id", "left").groupBy("paper_id").agg(F.countDistinct("evidence_id").alias("n_evidence"), F.countDistinct("relation_id").alias("n_relations"))
    return papers(spark, sf).select("paper_id").join(per, "paper_id", "left").fillna(0, ["n_evidence", "n_relations"])


@query("""SELECT p_partkey AS relation_id, coalesce(n, 0) AS evidence_count, CASE WHEN d.event_type = 'purchase' THEN 'include' WHEN d.event_type = 'error' THEN 'exclude' WHEN d.event_type IS NULL THEN 'undecided' ELSE 'defer' END AS decision FROM part
LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) d ON d.user_id = p_partkey""")
def relation_decision_counts(spark, sf):
    """Relations with their newest decision and evidence count"""
    counts = links(spark, sf).groupBy("relation_id").agg(F.count("*").alias("evidence_count"))
    decided = L.latest(load(spark, sf, "events").select(F.col("user_id").alias("relation_id"), "event_id", "event_type"), ["relation_id"], "event_id").select("relation_id", "event_type")
    kind = F.when(F.col("event_type") == "purchase", "include").when(F.col("event_type") == "error", "exclude").when(F.col("event_type").isNull(), "undecided").otherwise("defer")
    return relations(spark, sf).select("relation_id").join(counts, "relation_id", "left").join(decided, "relation_id", "left").select("relation_id", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), kind.alias("decision"))


@query("""SELECT n_nationkey AS project_id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_papers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_members,
(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS n_evidence,
(SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS n_links,
(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'F') AS n_decided FROM nation""")
def project_dashboard(spark, sf):
    """Five counts, each aggregated before it is joined"""
    p, e = papers(spark, sf), load(spark, sf, "orders")
    homed = e.join(p, e["o_custkey"] == p["paper_id"]).select("domain_id", "o_orderkey", "o_orderstatus")
    spans = homed.groupBy("domain_id").agg(F.count("*").alias("n_evidence"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_decided"))
    linked = homed.join(links(spark, sf), F.col("o_orderkey") == F.col("evidence_id")).groupBy("domain_id").agg(F.count("*").alias("n_links"))
    members = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("domain_id")).agg(F.count("*").alias("n_members"))
    out = load(spark, sf, "nation").select(F.col("n_nationkey").alias("domain_id"), F.col("n_name").alias("name"))
    for part in (p.groupBy("domain_id").agg(F.count("*").alias("n_papers")), members, spans, linked):
        out = out.join(part, "domain_id", "left")
    return out.fillna(0).withColumnRenamed("domain_id", "project_id")


_OLD = "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber = 1"
_NEW = "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber = 2"


@query(f"""SELECT coalesce(o.k, n.k) AS relation_id, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k""")
def version_diff(spark, sf):
    """Two versions of a relation set"""
    rows = load(spark, sf, "lineitem").withColumnRenamed("l_partkey", "relation_id")
    return L.version_diff(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), "relation_id")


@query("""SELECT p_partkey AS relation_id, p_brand AS source, 'held' AS origin FROM part WHERE p_size <= 25
UNION ALL SELECT p_partkey, p_brand, 'new' FROM part WHERE p_size > 20 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def insert_ignore(spark, sf):
    """Rows whose key is held already are left as they are"""
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("relation_id"), F.col("p_brand").alias("source"), "p_size")
    held, new = (rows.where(w).select("relation_id", "source", F.lit(o).alias("origin")) for w, o in (("p_size <= 25", "held"), ("p_size > 20", "new")))
    return L.insert_ignore(held, new, "relation_id")


@query("""SELECT coalesce(b.c_custkey, a.c_custkey) AS paper_id, CASE WHEN b.c_custkey IS NOT NULL AND (a.c_custkey IS NULL OR length(b.s) >= length(a.s)) THEN b.s ELSE a.s END AS summary,
least(a.t, b.t) AS tier, CASE WHEN b.c_custkey IS NOT NULL AND b.l <> '' THEN b.l ELSE a.l END AS license, CASE WHEN b.c_custkey IS NOT NULL THEN b.n ELSE a.n END AS title
FROM (SELECT c_custkey, c_name || c_mktsegment AS s, c_custkey % 3 AS t, 'old' AS l, c_name AS n FROM customer WHERE c_custkey % 2 = 0) a
FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_name || '-' || c_mktsegment END AS s, c_custkey % 4 AS t, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'new' END AS l, lower(c_name) AS n FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.c_custkey""")
def paper_upsert_merge(spark, sf):
    """Column-wise merge of papers"""
    c, k = load(spark, sf, "customer"), F.col("c_custkey")
    held = c.where(k % 2 == 0).select(k.alias("paper_id"), F.concat("c_name", "c_mktsegment").alias("summary"), (k % 3).alias("tier"), F.lit("old").alias("license"), F.col("c_name").alias("title"))
    text = F.when(k % 5 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("-"), "c_mktsegment"))
    new = c.where(k % 3 == 0).select(k.alias("paper_id"), text.alias("summary"), (k % 4).alias("tier"), F.when(k % 7 == 0, "").otherwise("new").alias("license"), F.lower("c_name").alias("title"))
    return L.upsert_papers(held, new)


@query("""SELECT user_id AS slice_id, event_type AS paper_kind, max(value) AS relevance, max(event_id) AS last_seen, count(*) AS retrieval_count FROM events GROUP BY 1, 2""")
def slice_attach(spark, sf):
    """Relevance keeps its maximum, retrievals add up"""
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("slice_id"), F.col("event_type").alias("paper_kind")).agg(F.max("value").alias("relevance"), F.max("event_id").alias("last_seen"), F.count("*").alias("retrieval_count"))


@query("""SELECT user_id AS relation_id, max(event_id) AS seq, arg_max(event_type, event_id) AS decision, CASE WHEN arg_max(value, event_id) > 5 THEN 'human' ELSE 'ai_panel' END AS decided_by FROM events GROUP BY 1""")
def last_decision(spark, sf):
    """The last write wins, and who made it stays known"""
    rows = load(spark, sf, "events").select(F.col("user_id").alias("relation_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("decision"), F.when(F.col("value") > 5, "human").otherwise("ai_panel").alias("decided_by"))
    return L.latest(rows, ["relation_id"], "seq")


@query("""WITH p AS (SELECT doc_id AS paper_id, CASE WHEN doc_id % 4 = 0 THEN '10.1000/' || (n_chars % 97) ELSE '' END AS doi, CASE WHEN doc_id % 4 = 1 THEN 'https://X.org/' || (n_chars % 89) || '/' ELSE '' END AS url, CAST(doc_id % 3 AS INTEGER) AS tier, length(text) AS n FROM documents),
k AS (SELECT *, CASE WHEN doi <> '' THEN lower(doi) WHEN url <> '' THEN lower(regexp_replace(url, '/+$', '')) ELSE CAST(paper_id AS VARCHAR) END AS dedupe_key FROM p)
SELECT paper_id, dedupe_key, tier FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY tier, n DESC, paper_id) AS r FROM k) WHERE r = 1""")
def federated_dedupe(spark, sf):
    """One paper for each identifier of several sources"""
    d, k = load(spark, sf, "documents"), F.col("doc_id")
    rows = d.select(k.alias("paper_id"), F.when(k % 4 == 0, F.concat(F.lit("10.1000/"), (F.col("n_chars") % 97).cast("string"))).otherwise("").alias("doi"), F.when(k % 4 == 1, F.concat(F.lit("https://X.org/"), (F.col("n_chars") % 89).cast("string"), F.lit("/"))).otherwise("").alias("url"), (k % 3).cast("int").alias("tier"), F.col("text").alias("summary"))
    return L.federated(rows).select("paper_id", "dedupe_key", "tier")


@query("""SELECT 'evidence' AS table_name, count(*) AS deleted FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)
UNION ALL SELECT 'papers', count(*) FROM customer WHERE c_nationkey = 5""")
def cascade_delete(spark, sf):
    """What a deletion takes from each table"""
    p, e = papers(spark, sf), evidence(spark, sf)
    return L.cascade_delete(p.where("domain_id = 5").select("paper_id"), {"papers": p, "evidence": e}, "paper_id")[1]


@query("""WITH s AS (SELECT doc_id AS paper_id, 2015 + doc_id % 10 AS year, CAST(round((CASE WHEN contains(lower(text), 'tion') THEN 1.0 ELSE 0.0 END) + (CASE WHEN contains(lower(text), 'heit') THEN 1.0 ELSE 0.0 END) + (CASE WHEN contains(lower(text), 'license') THEN 1.0 ELSE 0.0 END) + 0.01 * (2015 + doc_id % 10 - 2020), 6) AS DOUBLE) AS score FROM documents)
SELECT paper_id, year, score FROM s WHERE score > 0 ORDER BY score DESC, year DESC, paper_id LIMIT 50""")
def lexical_search_topk(spark, sf):
    """Substring search with the bonus for newer years"""
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text", (2015 + F.col("doc_id") % 10).alias("year"))
    return L.search(rows, ["tion", "heit", "license"], 50).select("paper_id", "year", "score")


@query("""WITH r AS (SELECT p_partkey AS relation_id, p_brand AS source, CASE WHEN p_size % 2 = 0 THEN 'USES' ELSE 'REPORTS' END AS relation_type, p_type AS target, p_size > 10 AS accepted, p_retailprice AS confidence, p_size AS n_evidence, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS origin FROM part),
d AS (SELECT *, row_number() OVER (PARTITION BY lower(source), relation_type, lower(target) ORDER BY origin, accepted DESC, confidence DESC, n_evidence DESC, relation_id) AS n FROM r)
SELECT relation_id, source, relation_type, target, accepted, confidence, n_evidence, origin FROM d WHERE n = 1 ORDER BY origin, accepted DESC, confidence DESC, n_evidence DESC, relation_id LIMIT 60""")
def candidate_relations(spark, sf):
    """The project's relations first, one for each folded triple"""
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("relation_id"), F.col("p_brand").alias("source"), F.when(F.col("p_size") % 2 == 0, "USES").otherwise("REPORTS").alias("relation_type"), F.col("p_type").alias("target"), (F.col("p_size") > 10).alias("accepted"), F.col("p_retailprice").alias("confidence"), F.col("p_size").alias("n_evidence"))
    return L.candidates(p.where("relation_id % 10 = 0"), p.where("relation_id % 10 <> 0"), 60)


_SEEDS = "part of the standard steel order"


@query(f"""WITH e AS (SELECT p_type AS alias, min(p_partkey) AS entity_id, count(*) AS degree FROM part GROUP BY 1),
s AS (SELECT *, CAST((CASE WHEN length(alias) >= 3 AND contains('{_SEEDS}', lower(alias)) THEN 3 ELSE 0 END) + len(list_intersect(list_distinct(string_split(lower(alias), ' ')), string_split('{_SEEDS}', ' '))) AS BIGINT) AS score FROM e),
b AS (SELECT max(score) AS best FROM s)
SELECT entity_id, alias, degree, score FROM (SELECT * FROM s, b WHERE score >= greatest(2.0, 0.5 * best) ORDER BY score DESC, degree DESC, entity_id DESC LIMIT 4)
UNION ALL SELECT entity_id, alias, degree, score FROM (SELECT * FROM s, b WHERE best < 2 ORDER BY degree DESC, entity_id DESC LIMIT 3)""")
def seed_entities(spark, sf):
    """Entities to start a graph search from"""
    e = load(spark, sf, "part").groupBy(F.col("p_type").alias("alias")).agg(F.min("p_partkey").alias("entity_id"), F.count("*").alias("degree"))
    return L.seeds(e, _SEEDS).select("entity_id", "alias", "degree", "score")


@query("""WITH w AS (SELECT p_partkey AS paper_id, p_name AS title, p_size AS year, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9][a-z0-9-]+')), ['part', 'steel', 'the', '12', '120'])) AS BIGINT) AS overlap FROM part)
SELECT paper_id, year, overlap FROM w, (SELECT max(overlap) AS best FROM w) WHERE overlap > 0 OR best = 0 ORDER BY overlap DESC, year DESC, paper_id LIMIT 12""")
def title_overlap_select(spark, sf):
    """Papers whose titles share words with a question"""
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))
    return L.overlap_select(rows, "part steel the 120 12", 12).select("paper_id", "year", "overlap")


_GRAPH = "SELECT p_brand AS source, CASE p_size % 3 WHEN 0 THEN 'ADDRESSES' WHEN 1 THEN 'BENCHMARKS' ELSE 'EVALUATES_ON' END AS relation_type, CASE WHEN p_size % 3 = 2 THEN p_brand ELSE p_type END AS target, p_retailprice / 10000 AS confidence FROM part"


@query(f"""WITH r AS ({_GRAPH}), a AS (SELECT source AS method, target AS task, max(confidence) AS c FROM r WHERE relation_type = 'ADDRESSES' GROUP BY 1, 2), b AS (SELECT source AS dataset, target AS task, max(confidence) AS c FROM r WHERE relation_type = 'BENCHMARKS' GROUP BY 1, 2)
SELECT method, a.task, dataset, round(a.c + b.c, 6) AS score FROM a JOIN b ON a.task = b.task WHERE NOT EXISTS (SELECT 1 FROM r WHERE relation_type = 'EVALUATES_ON' AND r.source = method AND r.target = dataset) ORDER BY score DESC, method, a.task, dataset LIMIT 5""")
def research_gaps(spark, sf):
    """Method and data set meet on a task, but were never evaluated together"""
    k = F.col("p_size") % 3
    rows = load(spark, sf, "part").select(F.col("p_brand").alias("source"), F.when(k == 0, "ADDRESSES").when(k == 1, "BENCHMARKS").otherwise("EVALUATES_ON").alias("relation_type"), F.when(k == 2, F.col("p_brand")).otherwise(F.col("p_type")).alias("target"), (F.col("p_retailprice") / 10000).alias("confidence"))
    return L.gaps(rows)


@query("""SELECT c_custkey AS paper_id, array_to_string(list_slice(list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL))), 1, 4), '|') AS statements, count(o_orderkey) AS n_evidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def timeline_contributions(spark, sf):
    """Up to four distinct statements of each paper; papers without any stay, with null"""
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.array_join(F.slice(F.array_sort(F.nullif(F.collect_set("o_orderpriority"), F.array().cast("array<string>"))), 1, 4), "|").alias("statements"), F.count("o_orderkey").alias("n_evidence"))
    return papers(spark, sf).select("paper_id").join(o, "paper_id", "left").select("paper_id", "statements", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_included, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_deferred FROM orders GROUP BY 1""")
def month_buckets(spark, sf):
    """Decisions by month"""
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return load(spark, sf, "orders").groupBy(F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("none")).alias("month")).agg(F.count("*").alias("n"), n("F").alias("n_included"), n("O").alias("n_deferred"))


@query("""SELECT vt AS kind, id, part FROM (SELECT 'x' AS vt, c_custkey AS id, CASE WHEN c_nationkey < 5 THEN 0 WHEN c_acctbal > 0 THEN 1 ELSE 2 END AS part FROM customer WHERE c_nationkey < 5 OR c_acctbal > 0 OR c_custkey % 2 = 0)""")
def ordered_union(spark, sf):
    """Sources in order of precedence, the first row of each paper"""
    p = papers(spark, sf).select(F.col("paper_id").alias("id"), F.lit("x").alias("kind"), "domain_id", "balance")
    parts = [p.where(w).select("id", "kind") for w in ("domain_id < 5", "balance > 0", "id % 2 = 0")]
    return L.first_of_union(parts, "id").select("kind", "id", "part")


@query("""SELECT c_nationkey AS domain_id, c_custkey AS paper_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3""")
def snapshot_ranks(spark, sf):
    """Ranks inside a session"""
    return L.top(papers(spark, sf), [F.desc("balance"), F.col("paper_id")], 3, by=["domain_id"]).select("domain_id", "paper_id", "rank")


@query("""SELECT event_type AS route, count(*) AS n, count(*) FILTER (WHERE value < 1) AS n_failed, round(avg(value), 4) AS latency FROM events GROUP BY 1""")
def request_metrics(spark, sf):
    """Requests, failures and latency by route"""
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") < 1, 1)).alias("n_failed"), F.round(F.avg("value"), 4).alias("latency"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, sf):
    """Row counts of the store's tables"""
    out = None
    for t in TABLES:
        one = load(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
