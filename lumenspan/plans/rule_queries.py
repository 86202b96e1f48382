"""Queries over the driver's tables for the rules of review and retrieval, each beside its SQL.

Mapping (ours): documents are papers, lineitem rows claims, orders decisions and projects, events calls and answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import metrics as M
from lumenspan.functions import text as X
from lumenspan.operators import reports as R
from lumenspan.operators import rules as U
from lumenspan.plans.evidence_queries import PLURAL
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


ASKED = "the stupid river and report with that"
TOKENS = U.query_tokens(ASKED)
HITS = " + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in TOKENS)


def papers(spark, sf):
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("domain"), "text", F.substring("text", 1, 40).alias("title"), F.col("text").alias("summary"), (F.col("doc_id") % 4 + 1).alias("tier"), (2000 + F.col("doc_id") % 25).alias("year"), (F.col("doc_id") * 7919 % 10).alias("relevance"), (F.col("doc_id") * 104729 % 7).alias("retrieval_count"))


@query(f"""WITH d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS low FROM documents) SELECT doc_id AS paper_id, {HITS} >= 2 AS general, lang = 'fr' AS french FROM d""")
def relevant_papers(spark, sf):
    """Relevance to a general query, and to one routed to a domain"""
    p = papers(spark, sf)
    return p.select("paper_id", U.relevant(ASKED, "general", F.col("domain"), F.col("text")).alias("general"), U.relevant(ASKED, "fr", F.col("domain"), F.col("text")).alias("french"))


@query("""SELECT doc_id AS paper_id, lang AS domain, 1.0::DOUBLE AS relevance FROM documents UNION ALL SELECT doc_id, 'general', 0.8::DOUBLE FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) WHERE """ + HITS + " >= 2")
def dual_slices(spark, sf):
    """Papers in their own domain, and in the query's where they are relevant to it"""
    return U.dual_attach(papers(spark, sf), ASKED, "general")


@query(f"""WITH d AS (SELECT doc_id, doc_id % 4 + 1 AS tier, 2000 + doc_id % 25 AS year, lower(substring(text, 1, 40)) AS title, lower(substring(text, 1, 40) || ' ' || text) AS low, length(text) AS n FROM documents),
s AS (SELECT doc_id AS paper_id, CAST(tier = 1 AS INT) AS official, round({" + ".join(f"CASE WHEN contains(title, '{t}') THEN 3 WHEN contains(low, '{t}') THEN 1 ELSE 0 END" for t in TOKENS)} + greatest(0, 4 - tier) * 2 + least(2.0, n / 500), 6) AS score, year FROM d)
SELECT * FROM s ORDER BY official DESC, score DESC, year DESC, paper_id LIMIT 20""")
def federated_ranking(spark, sf):
    """Official sources first, then overlap, authority and length, then year (the top 20 are the report)"""
    return U.federated_rank(papers(spark, sf), ASKED, 20)


LIBRARY = [t for t in TOKENS if t not in U.NO_TERM]


@query(f"""WITH c AS (SELECT doc_id AS paper_id, doc_id % 4 + 1 AS tier, 2000 + doc_id % 25 AS year, lower(text) AS low, row_number() OVER (ORDER BY doc_id % 4 + 1, doc_id * 7919 % 10 DESC, doc_id * 104729 % 7 DESC, 2000 + doc_id % 25 DESC, doc_id) AS k FROM documents WHERE lang = 'en' QUALIFY k <= 100),
s AS (SELECT paper_id, {" + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in LIBRARY)} AS overlap, tier, year, k FROM c) SELECT paper_id, overlap, tier, year FROM s ORDER BY overlap DESC, tier, year DESC, k LIMIT 10""")
def library_cut_then_rank(spark, sf):
    """The first hundred of the domain by tier, relevance, retrieval count and year, then ranked by overlap"""
    return U.library_search(papers(spark, sf), ASKED, "en", 10)


ASKED_ALONE = ("How river report", "zzzq unheard", "知识图谱", "how 知识图谱", "How the")


@query("""WITH d AS (SELECT doc_id AS paper_id, lower(coalesce(text, '')) AS low FROM documents),
h AS (SELECT paper_id, 'How river report' AS asked, contains(low, 'river') OR contains(low, 'report') AS hit FROM d UNION ALL SELECT paper_id, 'zzzq unheard', contains(low, 'zzzq') OR contains(low, 'unheard') FROM d UNION ALL SELECT paper_id, '知识图谱', contains(low, '知识图谱') FROM d
  UNION ALL SELECT paper_id, 'how 知识图谱', contains(low, '知识图谱') FROM d UNION ALL SELECT paper_id, 'How the', contains(low, 'the') FROM d)
SELECT asked, paper_id, hit, bool_or(hit) OVER (PARTITION BY asked) AS relevant FROM h""")
def fallback_anchors(spark, sf):
    """Which papers hold an anchor of each query, and do all papers together answer it: some Latin anchor in any, without anchors a Chinese term"""
    found = papers(spark, sf)
    hits = found.select("paper_id", F.explode(F.array(*(F.struct(F.lit(q).alias("asked"), U.fallback_hit(q, F.col("text")).alias("hit")) for q in ASKED_ALONE))).alias("h")).select("h.asked", "paper_id", "h.hit")
    rows = [U.fallback_relevant(q, found).select(F.lit(q).alias("asked"), "relevant") for q in ASKED_ALONE]
    verdicts = rows[0]
    for r in rows[1:]:
        verdicts = verdicts.unionByName(r)
    return hits.join(F.broadcast(verdicts), "asked")  # one row for each query


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'scientific literature knowledge graph' WHEN 2 THEN 'scientific literature entity extraction relation extraction research idea generation' ELSE 'scientific literature' END AS terms FROM nation""")
def retrieval_terms(spark, sf):
    """Chinese requests as English search terms"""
    k = F.col("n_nationkey") % 4
    asked = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit("图谱"))).when(k == 2, F.lit("抽取 Idea")).otherwise(F.lit("论文"))
    return load(spark, sf, "nation").withColumn("asked", asked).select("n_nationkey", U.retrieval_query(F.col("asked")).alias("terms"))


# Triggers are ours: the fixed ones are in a schema file that isn't public.
TRIGGERS = [("USES", ("with", "from")), ("SUPPORTS", ("that",)), ("PART_OF", ("of", "in"))]
WORDS = [(w, kind) for kind, some in TRIGGERS for w in some]


@query("""WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g') || ' ' AS low FROM documents),
h AS (""" + " UNION ALL ".join(f"SELECT doc_id, strpos(low, ' {w} ') AS pos, strpos(low, ' {w} ') + {len(w)} AS stop, {n} AS n, '{kind}' AS kind FROM d" for n, (w, kind) in enumerate(WORDS)) + """),
f AS (SELECT doc_id, arg_min(kind, [pos, stop, n]) AS kind FROM h WHERE pos > 0 GROUP BY 1) SELECT doc_id AS paper_id, coalesce(kind, 'RELATED_TO') AS relation_type FROM documents LEFT JOIN f USING (doc_id)""")
def trigger_types(spark, sf):
    """The type of the trigger that begins first in a text"""
    return papers(spark, sf).select("paper_id", U.trigger_type(F.col("text"), TRIGGERS).alias("relation_type"))


@query("""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '  ') || ' ' AS w FROM documents) SELECT doc_id AS paper_id, regexp_matches(w, ' with .* of .* the ', 's') AS ordered FROM d""")
def ordered_triggers(spark, sf):
    """The words of a trigger in their order"""
    return papers(spark, sf).select("paper_id", U.in_order(F.col("text"), "with of the").alias("ordered"))


@query(f"""WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) || 's' WHEN 1 THEN lower(p_name) || '知识图谱-构建' WHEN 2 THEN 'c++ naïve-' || lower(p_name) ELSE 'single-cell ' || lower(p_name) END AS c FROM part), s AS (SELECT *, trim(regexp_replace(c, '[-_/\\s]+', ' ', 'g')) AS sep FROM k)
SELECT p_partkey, c AS case_key, sep AS separator_key, array_to_string(list_transform(string_split(sep, ' '), lambda w: {PLURAL}), ' ') AS plural_key FROM s""")
def concept_key_levels(spark, sf):
    """Keys by case, by separators and by plurals, of names in several scripts and widths"""
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.upper(n), F.lit("s."))).when(k == 1, F.concat(F.lit("(!"), n, F.lit("知识图谱－构建)"))).when(k == 2, F.concat(F.lit("Ｃ++  NAÏVE-"), n, F.lit("?*"))).otherwise(F.concat(F.lit(" Single-Cell "), n))
    return load(spark, sf, "part").withColumn("k", U.concept_keys(name, X.singular)).select("p_partkey", "k.*")


@query("""SELECT row_id, folded FROM (SELECT n_nationkey AS row_id, lower(n_name) || ' of ' || lower(n_name) AS folded FROM nation)""")
def folded_labels(spark, sf):
    """Labels with white space squeezed and case folded"""
    return load(spark, sf, "nation").select(F.col("n_nationkey").alias("row_id"), U.folded(F.concat(F.lit("  "), "n_name", F.lit(" \t of\n "), F.upper("n_name"))).alias("folded"))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_linenumber % 4 AS n, l_suppkey % 3 AS bad, CASE l_suppkey % 5 WHEN 0 THEN 'proves' WHEN 1 THEN 'trying to use' ELSE 'uses' END AS r, CASE WHEN l_suppkey % 7 = 0 THEN 'RELATED_TO' ELSE 'USES' END AS t, l_partkey % 2 = 0 AS v, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 = 1 END AS b, l_discount * 10 AS conf FROM lineitem),
k AS (SELECT claim_id, array_to_string(list_filter([CASE WHEN n = 0 THEN 'no_evidence' END, CASE WHEN bad > 0 THEN 'invalid_evidence' END, CASE WHEN n = 1 THEN 'single_source' END, CASE WHEN r = 'proves' THEN 'absolute_predicate' END, CASE WHEN r LIKE 'trying%' THEN 'progressive_predicate' END, CASE WHEN t = 'RELATED_TO' THEN 'cooccurrence_only' END, CASE WHEN NOT v THEN 'type_mismatch' END, CASE WHEN NOT b THEN 'ends_not_covered' END, CASE WHEN conf < 0.7 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS codes FROM c)
SELECT codes, count(*) AS n FROM (SELECT CASE WHEN codes = '' THEN 'consistent' ELSE codes END AS codes FROM k) GROUP BY 1""")
def rule_criticisms(spark, sf):
    """What the rule critic finds in each claim, counted"""
    r = F.when(F.col("l_suppkey") % 5 == 0, "Proves").when(F.col("l_suppkey") % 5 == 1, "trying to use").otherwise("uses")
    c = load(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_linenumber") % 4).alias("n_evidence"), (F.col("l_suppkey") % 3).alias("n_invalid"), r.alias("relation"),
        F.when(F.col("l_suppkey") % 7 == 0, "RELATED_TO").otherwise("USES").alias("relation_type"), (F.col("l_partkey") % 2 == 0).alias("types_valid"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 3 == 1).alias("covers_both"), (F.col("l_discount") * 10).alias("confidence"))
    return U.rule_critic(c, X.PROGRESSIVE_MARKERS).groupBy(F.array_join("criticisms", ",").alias("codes")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT o_orderkey AS claim_id, o_orderstatus AS s, o_custkey % 4 = 0 OR o_orderkey % 9 = 0 AS stop FROM orders) SELECT claim_id, CASE WHEN stop THEN 'rejected' WHEN s = 'F' THEN 'accepted' WHEN s = 'O' THEN 'needs_review' ELSE 'rejected' END AS status, stop AND s IN ('F', 'O') AS overruled FROM g""")
def guarded_decisions(spark, sf):
    """Decisions that the hard guard overrules"""
    s = F.col("o_orderstatus")
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(s == "F", "accepted").when(s == "O", "needs_review").otherwise("rejected").alias("status"), (F.col("o_custkey") % 4).alias("n_valid"), F.when(F.col("o_orderkey") % 9 == 0, "Guarantees").otherwise("uses").alias("relation"))
    return U.guarded(d)


@query("""SELECT l_orderkey * 10 + l_linenumber AS relation_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND contains(lower('part ' || l_partkey || ' uses ' || 'supplier ' || l_suppkey), 'part 1') ORDER BY 1 LIMIT 200""")
def browsed_relations(spark, sf):
    """Relations by decision, status and a word; the first 200 are what is shown"""
    r = load(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("target"), F.lit("uses").alias("kind"), F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("decision"))
    return U.browsed(r, "R", "F", "part 1").select("relation_id")


@query("""SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1""")
def papers_with_evidence(spark, sf):
    """Papers that are no metadata alone, by domain"""
    excluded = load(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("paper_id"))
    return U.evidence_papers(papers(spark, sf), excluded).groupBy(F.col("domain").alias("lang")).agg(F.count("*").alias("n"))


@query("""SELECT l_shipdate_year AS variant, count(*) AS n FROM (SELECT CAST(year(l_shipdate) AS INT) AS l_shipdate_year, l_returnflag, l_linestatus FROM lineitem) WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') GROUP BY 1""")
def experiment_subset(spark, sf):
    """P10: cases of the variants and error types asked for"""
    c = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_orderkey").alias("claim_id"), F.col("l_linestatus").alias("error_type"), F.year("l_shipdate").alias("y"))
    return U.case_subset(c, variants=("A", "R"), errors=("F",)).groupBy(F.col("y").alias("variant")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS run_id, count(o_orderkey) AS n_evidence, count(o_orderkey) > 0 AS may_start FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def runs_that_may_start(spark, sf):
    """Runs without any evidence are refused"""
    return U.runnable(load(spark, sf, "customer").select(F.col("c_custkey").alias("run_id")), load(spark, sf, "orders").select(F.col("o_custkey").alias("run_id")))


@query("""SELECT o_custkey AS project_id, o_orderkey AS relation_id FROM orders WHERE o_orderpriority NOT LIKE '1%'""")
def undone_decisions(spark, sf):
    """Decisions left after some were cleared"""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("relation_id"), "o_orderpriority")
    return U.undone(o.select("project_id", "relation_id"), o.where("o_orderpriority LIKE '1%'"))


@query("""SELECT o_custkey AS project_id, 1 + CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 5 ELSE 0 END AS version, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1, 2""")
def graph_snapshots(spark, sf):
    """The next version of each project's graph, its relations counted"""
    edges = load(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("relation_id"))
    old = edges.where("project_id % 2 = 0").select("project_id", (F.col("project_id") % 5).alias("version"), "relation_id")
    return U.snapshot(edges.union(edges), old).groupBy("project_id", "version").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS session_id, arg_max(event_id, [epoch_us(ts), event_id]) AS answer_id FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def shown_answers(spark, sf):
    """The last answer shown in each session"""
    e = load(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("answer_id"), F.col("ts").alias("created"), F.col("event_type").isin("view", "click").alias("shown"))
    return U.shown_answer(e)


@query("""SELECT o_orderkey AS project_id, o_custkey AS user_id, 'owner' AS role FROM orders UNION ALL SELECT DISTINCT o_orderkey, o_custkey + 1, CASE WHEN o_custkey % 2 = 0 THEN 'editor' ELSE 'viewer' END FROM orders""")
def project_roles(spark, sf):
    """Owners, and members of other people's projects"""
    o = load(spark, sf, "orders")
    owners = o.select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("user_id"))
    other = owners.select("project_id", (F.col("user_id") + 1).alias("user_id"), F.when(F.col("user_id") % 2 == 0, "editor").otherwise("viewer").alias("role"))
    return U.roles(owners, other.union(owners.select("project_id", "user_id", F.lit("viewer"))))


@query("""SELECT count(*) FILTER (WHERE event_type <> 'error') AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed_calls, CAST(sum(event_id % 3) AS BIGINT) AS retries, CAST(sum(event_id % 100) FILTER (WHERE event_type <> 'error') AS BIGINT) AS input_tokens, CAST(sum(user_id) FILTER (WHERE event_type <> 'error') AS BIGINT) AS output_tokens, round(CAST(sum(event_id % 7) FILTER (WHERE event_type <> 'error') AS DOUBLE), 1) AS duration_ms FROM events""")
def model_usage(spark, sf):
    """Calls, tokens and time summed up"""
    e = load(spark, sf, "events")
    return U.usage(e.select((F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 3).alias("retries"), (F.col("event_id") % 100).alias("input_tokens"), F.col("user_id").alias("output_tokens"), (F.col("event_id") % 7).cast("double").alias("duration_ms")))


@query(r"""WITH p AS (SELECT conv_id AS document_id, regexp_replace(coalesce(CASE WHEN turn = 3 THEN substring(text, 1, 30) WHEN turn > 3 AND conv_id % 3 = 0 THEN ' same page ' ELSE text END, ''), '^\s+|\s+$', '', 'g') AS t, (turn > 1 OR conv_id % 2 = 0)::INT AS img FROM conversations),
q AS (SELECT *, count(*) OVER (PARTITION BY document_id, t) AS c FROM p)
SELECT document_id, count(*) AS n_pages, count(*) FILTER (WHERE length(t) < 10) AS n_empty, count(*) FILTER (WHERE contains(t, '�')) AS n_replacement, count(*) FILTER (WHERE length(t) < 50 AND img > 0) AS n_scanned, count(*) FILTER (WHERE c > 1) AS n_duplicate,
sum(length(t))::BIGINT AS n_chars, sum(len(regexp_extract_all(t, '\S+')))::BIGINT AS n_words, 2 * count(*) FILTER (WHERE length(t) < 50 AND img > 0) > count(*) AS is_scanned FROM q GROUP BY 1""")
def page_quality(spark, sf):
    """Empty, repeated, damaged and scanned pages of each document, and whether it is a scan"""
    c = load(spark, sf, "conversations")
    text = F.when(F.col("turn") == 3, F.substring("text", 1, 30)).when((F.col("turn") > 3) & (F.col("conv_id") % 3 == 0), " same page ").otherwise(F.col("text"))
    return U.page_quality(c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), text.alias("text"), ((F.col("turn") > 1) | (F.col("conv_id") % 2 == 0)).cast("int").alias("n_images")))


@query("""WITH v AS (SELECT o_orderkey AS path_id, o_orderkey % 3 AS gap, (o_orderkey % 5) / 4.0 AS coverage, (o_custkey % 10) / 20.0 AS ms FROM orders), r AS (SELECT *, gap <= 1 AND coverage >= 0.8 AND ms <= 0.2 AS ok FROM v),
b AS (SELECT r.*, CASE WHEN path_id % 8 < 7 AND path_id % 2 = 0 THEN CASE WHEN path_id % 16 = 2 THEN 'too_hard' ELSE 'suitable' END END AS h FROM r),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_rule, count(*) FILTER (WHERE gap > 1) AS failed_gap, count(*) FILTER (WHERE coverage < 0.8) AS failed_coverage, count(*) FILTER (WHERE ms > 0.2) AS failed_mastered, count(h) AS n_human, count(*) FILTER (WHERE h = 'suitable') AS n_suitable, count(*) FILTER (WHERE (h = 'suitable') = ok) AS n_agree FROM b),
w AS (SELECT *, n_suitable / n_human AS p, """ + str(M.Z_REPORT) + """ AS z FROM a), i AS (SELECT *, greatest(0, (p + z * z / (2 * n_human) - z * sqrt(p * (1 - p) / n_human + z * z / (4.0 * n_human * n_human))) / (1 + z * z / n_human)) AS lo, least(1, (p + z * z / (2 * n_human) + z * sqrt(p * (1 - p) / n_human + z * z / (4.0 * n_human * n_human))) / (1 + z * z / n_human)) AS hi FROM w)
SELECT n, n_rule, failed_gap, failed_coverage, failed_mastered, n_human, n_suitable, n_agree, round(n_rule / n, 6) AS rule_accuracy, round(p, 6) AS human_accuracy, round(n_agree / n_human, 6) AS agreement, round(lo, 6) AS low, round(hi, 6) AS high, n_human >= 100 AND p >= 0.85 AND lo >= 0.8 AS can_claim FROM i""")
def adaptation_report(spark, sf):
    """The rule's verdicts beside people's, with the gates"""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = load(spark, sf, "orders").select(k.alias("path_id"), (k % 3).alias("gap"), ((k % 5) / 4.0).alias("coverage"), ((c % 10) / 20.0).alias("mastered_share"))
    v = v.withColumn("suitable", (F.col("gap") <= 1) & (F.col("coverage") >= 0.8) & (F.col("mastered_share") <= 0.2))
    human = v.where("path_id % 8 < 7 AND path_id % 2 = 0").select("path_id", F.when(F.col("path_id") % 16 == 2, "too_hard").otherwise("suitable").alias("verdict"))
    return U.adaptation_summary(v, human, M.wilson)
