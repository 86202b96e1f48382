"""Review, panel, claim and adjudication queries over the driver's tables, each with its SQL where SQL can say it.

Mapping (ours): conversations are runs and turns their claims; part is a set of relations; pages and documents
are papers. Numbers made from synthetic tables exercise the rules and mean nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.operators import extraction as E
from lumenspan.operators import review as V
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey AS claim_id, round(greatest(0.60, least(0.99, 0.80 - (CASE WHEN p_size % 2 = 0 THEN 0.08 ELSE 0 END) - (CASE WHEN p_size % 3 = 0 THEN 0.10 ELSE 0 END) - (CASE WHEN p_size % 5 = 0 THEN 0.08 ELSE 0 END) - (CASE WHEN p_size % 7 = 0 THEN 0.04 ELSE 0 END))), 6)::DOUBLE AS confidence FROM part""")
def mechanism_confidence(spark, sf):
    """N18"""
    return load(spark, sf, "part").select(F.col("p_partkey").alias("claim_id"), V.mechanism_confidence([F.col("p_size") % n == 0 for n in (2, 3, 5, 7)]).alias("confidence"))


@query("""WITH c AS (SELECT conv_id AS run_id, turn AS claim_no, list_distinct(list_filter([CAST(length(text) % 50 AS VARCHAR), CAST(turn AS VARCHAR), ''], lambda x: x <> '')) AS d, [CAST(length(text) % 50 AS VARCHAR), CAST(turn AS VARCHAR)] AS ids, length(text) % 150 / 100 AS score FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 8),
e AS (SELECT run_id, claim_no, score, list_filter(CASE WHEN ids[1] = ids[2] THEN ids[1:1] ELSE ids END, lambda x: CAST(x AS BIGINT) < 25) AS kept FROM c)
SELECT run_id, claim_no, array_to_string(kept, '|') AS ids, round(greatest(0, least(0.99, score)), 6)::DOUBLE AS confidence, CASE WHEN len(kept) = 0 OR score < 0.5 THEN 'rejected' ELSE 'review' END AS status FROM e""")
def live_claim_validation(spark, sf):
    """N26, P12"""
    text = F.length("text") % 50
    rows = load(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("claim_no"), F.array(text.cast("string"), F.col("turn").cast("string"), F.lit("")).alias("ids"), ((F.length("text") % 150) / 100).alias("score"))
    return V.live_claims(rows, spark.range(25).select(F.col("id").cast("string").alias("id")))


@query("""SELECT p_partkey AS claim_id, unnest(range(3))::INTEGER AS line, unnest(['proposer', 'critic', 'judge']) AS speaker, unnest(['proposed', '2 parts', printf('%.2f', 0.5 + p_size / 4 - 2.0) || ' ' || p_brand]) AS said FROM part""")
def panel_transcript(spark, sf):
    """N29"""
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("status"), F.array(0.5 + F.col("p_size") / 4, F.lit(-2.0)).alias("parts"))
    return V.transcript(rows)


@query("""SELECT kind, count(*) AS n FROM (SELECT p_type AS kind FROM part UNION ALL SELECT 'CONTAINS' FROM orders UNION ALL SELECT 'MENTIONS' FROM lineitem) GROUP BY 1""")
def claim_graph_edges(spark, sf):
    """Edges of the claim graph by kind"""
    p = load(spark, sf, "part")
    e = load(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("paper_id"))
    relations = p.select(F.col("p_partkey").alias("source"), F.col("p_size").alias("target"), F.col("p_type").alias("type"))
    mentions = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_partkey").alias("entity_id"))
    edges = V.graph_tables(p.select(F.col("p_partkey").alias("entity_id")), e.select("paper_id").distinct(), e, relations, mentions)[1]
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS claim_id, array_to_string(list_filter([CASE WHEN NOT coalesce(n_chars > 300, true) THEN 'evidence' END, CASE WHEN NOT coalesce(quality = 1, true) THEN 'quality' END, CASE WHEN NOT coalesce(toxic = 0, true) THEN 'tone' END], lambda x: x IS NOT NULL), '|') AS faults FROM documents LEFT JOIN labels USING (doc_id)""")
def critic_faults(spark, sf):
    """A missing answer is no fault"""
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("claim_id"), F.array_join(V.critic_faults({"evidence": F.col("n_chars") > 300, "quality": F.col("quality") == 1, "tone": F.col("toxic") == 0}), "|").alias("faults"))


@query("""WITH p AS (SELECT c_custkey AS profile_id, c_custkey % 101 AS a, c_custkey * 7 % 101 AS b, c_custkey * 13 % 101 AS c, c_nationkey % 5 + 1 AS expected FROM customer), m AS (SELECT *, round((a + b + c) / 3, 1) AS readiness FROM p),
l AS (SELECT *, CASE WHEN readiness <= 45 THEN 1 WHEN readiness <= 60 THEN 2 WHEN readiness <= 75 THEN 3 WHEN readiness <= 88 THEN 4 ELSE 5 END AS level FROM m)
SELECT profile_id, readiness, level, greatest(0, 100 - 18 * abs(level - expected))::INTEGER AS match, array_to_string(list_transform(list_sort(list_filter([{'v': a, 'k': 'a'}, {'v': b, 'k': 'b'}, {'v': c, 'k': 'c'}], lambda x: x.v < 70)), lambda x: x.k), '|') AS blind_spots FROM l""")
def learner_diagnosis(spark, sf):
    """X23"""
    k = F.col("c_custkey")
    scores = F.create_map(F.lit("a"), (k % 101).cast("int"), F.lit("b"), (k * 7 % 101).cast("int"), F.lit("c"), (k * 13 % 101).cast("int"))
    return V.diagnosis(load(spark, sf, "customer").select(k.alias("profile_id"), scores.alias("scores"), (F.col("c_nationkey") % 5 + 1).alias("expected")))


_WORDS = ("Suitable", "hard", "过易", "ok", "unsure")


@query(f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN lower(w) IN ('suitable', 'ok') THEN 'suitable' WHEN lower(w) = 'hard' THEN 'too_hard' WHEN w = '过易' THEN 'too_easy' ELSE w END AS verdict FROM (SELECT {list(_WORDS)!r}[(c_custkey % 5 + 1)::INTEGER] AS w FROM customer)) GROUP BY 1""")
def human_verdicts(spark, sf):
    """X26"""
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return load(spark, sf, "customer").groupBy(V.human_verdict(word).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT doc_id, instr(lower(text), 'the')::INTEGER AS h, instr(lower(text), 'hea')::INTEGER AS t FROM documents) SELECT doc_id, h AS head_at, CASE WHEN h > 0 AND t > 0 AND t < h + 3 AND h < t + 3 THEN 0 ELSE t END AS tail_at FROM h""")
def entity_highlight(spark, sf):
    """X35"""
    return load(spark, sf, "documents").select("doc_id", V.highlights(F.col("text"), F.lit("The"), F.lit("HEA")).alias("h")).select("doc_id", "h.*")


@query("""WITH t AS (SELECT p_type AS topic, count(*) AS n, 2020 + max(p_size) % 6 AS y FROM part GROUP BY 1), big AS (SELECT topic FROM t ORDER BY n DESC, topic LIMIT 8), k AS (SELECT DISTINCT least(a.p_type, b.p_type) AS a, greatest(a.p_type, b.p_type) AS b FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 WHERE a.p_size = b.p_size)
SELECT rule, gap FROM (SELECT 0 AS rule, topic AS gap FROM t WHERE n <= 2 AND y >= 2023 UNION ALL SELECT DISTINCT 1, topic FROM t JOIN part ON p_type = topic AND p_size = 13 UNION ALL SELECT 2, a.topic || ' / ' || b.topic FROM big a JOIN big b ON a.topic < b.topic WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = a.topic AND k.b = b.topic)) ORDER BY 1, 2 LIMIT 8""")
def topic_gaps(spark, sf):
    """A29"""
    p = load(spark, sf, "part")
    topics = p.groupBy(F.col("p_type").alias("topic")).agg(F.count("*").alias("n_papers"), (2020 + F.max("p_size") % 6).alias("last_year"))
    after = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_type").alias("b"), F.col("p_size").alias("s"))
    return V.topic_gaps(topics, p.where("p_size = 13").select(F.col("p_type").alias("topic")), p.join(after, "p_partkey").where("p_size = s").select(F.col("p_type").alias("a"), "b"))


@query("""WITH c AS (SELECT user_id AS run_id, CASE WHEN event_type IN ('view', 'click') THEN 'accepted' ELSE 'rejected' END AS s, event_id % 3 AS i, event_id % 5 AS p FROM events)
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE s = 'accepted') AS n_accepted, round(CASE WHEN count(*) FILTER (WHERE s = 'accepted') > 0 THEN 100 * count(*) FILTER (WHERE s = 'accepted' AND (i = 0 OR p = 0)) / count(*) FILTER (WHERE s = 'accepted') ELSE 100.0 END, 4) AS unsupported FROM c GROUP BY 1""")
def run_metrics(spark, sf):
    """A38, A39"""
    rows = load(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type").isin("view", "click"), "accepted").otherwise("rejected").alias("status"), (F.col("event_id") % 3).alias("n_ids"), (F.col("event_id") % 5).alias("n_spans"))
    return V.run_metrics(rows)


@query("""SELECT l_orderkey AS claim_id, arg_min(l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1000 ELSE 2000 END + l_linenumber) AS ordinal, CASE arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1000 ELSE 2000 END + l_linenumber) WHEN 'R' THEN 'accepted' WHEN 'A' THEN 'needs_review' ELSE 'rejected' END AS status FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag DESC) GROUP BY 1""")
def best_evidence(spark, sf):
    """W14"""
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ordinal")).agg(F.max("l_returnflag").alias("f"))
    return V.best_evidence(rows.select("claim_id", "ordinal", F.when(F.col("f") == "R", "accepted").when(F.col("f") == "A", "needs_review").otherwise("rejected").alias("status")))


@query("""WITH s AS (SELECT doc_id, i - 1 AS i, t FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))),
b AS (SELECT doc_id, i, t, unnest(range(greatest(0, ceil((i - 4) / 4.0))::BIGINT, floor(i / 4.0)::BIGINT + 1)) AS block FROM s) SELECT doc_id AS paper_id, block::INTEGER AS block, count(*) AS n, sha256(string_agg(t, ' ' ORDER BY i)) AS text_sha256 FROM b GROUP BY 1, 2""")
def sentence_blocks(spark, sf):
    """Blocks of five sentences that share one"""
    out = V.blocks(E.plain_spans(load(spark, sf, "documents")), 5, 1)
    return out.select("paper_id", "block", "n", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS sections, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS source_text FROM documents""")
def ingestion_redaction(spark, sf):
    """M10"""
    rows = load(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("sections"), F.sha2("text", 256).alias("source_text"), (F.col("doc_id") % 2 == 0).alias("consent"))
    return V.redacted(rows).drop("consent")


@query("""SELECT substring(text, 1, 12) AS criticism, count(*) AS n FROM conversations GROUP BY 1 ORDER BY n DESC, criticism LIMIT 3""")
def criticism_histogram(spark, sf):
    """A35"""
    return load(spark, sf, "conversations").groupBy(F.substring("text", 1, 12).alias("criticism")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "criticism").limit(3)


@query("""SELECT p.n_nationkey AS profile, a.adjustment, round(avg(c_acctbal), 4) AS mean_score, greatest(1, least(5, n_regionkey + a.adjustment))::INTEGER AS target FROM nation p JOIN customer ON c_nationkey = n_nationkey CROSS JOIN (SELECT unnest([-1, 0, 1]) AS adjustment) a GROUP BY 1, 2, n_regionkey""")
def regression_matrix(spark, sf):
    """Profiles by three adjustments (25 by 3 rows meet)"""
    base = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("profile")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean_score"))
    rows = load(spark, sf, "nation").select(F.col("n_nationkey").alias("profile"), "n_regionkey").join(base, "profile")
    rows = rows.withColumn("adjustment", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    return rows.select("profile", "adjustment", "mean_score", F.greatest(F.lit(1), F.least(F.lit(5), F.col("n_regionkey") + F.col("adjustment"))).alias("target"))


@query("""WITH m AS (SELECT p_brand AS node, count(*) AS n FROM part GROUP BY 1) SELECT node, n, round(14 + 22 * sqrt(n / (SELECT max(n) FROM m)), 4) AS size FROM m""")
def atlas_node_size(spark, sf):
    """X30"""
    m = load(spark, sf, "part").groupBy(F.col("p_brand").alias("node")).agg(F.count("*").alias("n"))
    return m.crossJoin(F.broadcast(m.agg(F.max("n").alias("_m")))).select("node", "n", F.round(14 + 22 * F.sqrt(F.col("n") / F.col("_m")), 4).alias("size"))


@query("""SELECT p_brand AS alias, min(p_partkey) AS entity_id, arg_min(p_type, p_partkey) AS entity_type, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS aliases FROM part GROUP BY 1""")
def alias_registry(spark, sf):
    """Aliases are joined, the first type wins"""
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("alias")).agg(F.min("p_partkey").alias("entity_id"), F.min_by("p_type", "p_partkey").alias("entity_type"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("aliases"))


@query("""SELECT p_partkey AS relation_id, p_brand AS source, p_type AS target, p_size AS confidence FROM part WHERE p_size > 20 AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 45) AND p_type IN (SELECT p_type FROM part WHERE p_size > 45)""")
def accepted_edges(spark, sf):
    """Accepted edges whose two ends exist"""
    p = load(spark, sf, "part")
    ends = p.where("p_size > 45")
    out = p.where("p_size > 20").join(ends.select("p_brand"), "p_brand", "left_semi").join(ends.select("p_type"), "p_type", "left_semi")
    return out.select(F.col("p_partkey").alias("relation_id"), F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.col("p_size").alias("confidence"))


@query("""SELECT doc_id AS evidence_id FROM documents WHERE (CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'accepted' ELSE 'rejected' END IS NULL OR doc_id % 3 = 1) AND source <> '' AND n_chars > 500""")
def usable_evidence(spark, sf):
    """Status absent or accepted, paper and place given, end after start"""
    k = F.col("doc_id") % 3
    status = F.when(k == 1, "accepted").when(k == 2, "rejected")
    d = load(spark, sf, "documents").withColumn("status", status).withColumn("char_end", F.coalesce(F.expr("try_cast(cast(n_chars - 500 as string) as int)"), F.lit(0)))
    return d.where((F.col("status").isNull() | (F.col("status") == "accepted")) & (F.col("source") != "") & (F.col("char_end") > 0)).select(F.col("doc_id").alias("evidence_id"))


@query("""SELECT c_custkey AS paper_id, count(l_orderkey) AS n_candidates, count(*) FILTER (WHERE l_returnflag = 'R') AS n_included, count(DISTINCT o_orderkey) AS n_evidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def paper_matrix(spark, sf):
    """Candidates, included and evidence of each paper"""
    per = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("i"))
    o = load(spark, sf, "orders").join(per, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.sum("c").alias("n_candidates"), F.sum("i").alias("n_included"), F.count("*").alias("n_evidence"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id")).join(o, "paper_id", "left").fillna(0)


@query("""SELECT l_partkey AS relation_id, o_orderkey AS evidence_id, o_custkey AS paper_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def project_bundle(spark, sf):
    """Spans of the selected papers' relations; a shared span stays once for each relation"""
    chosen = load(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))  # the project's papers
    o = load(spark, sf, "orders").join(chosen, "o_custkey", "left_semi")
    return load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("relation_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("paper_id"))


@query("""SELECT coalesce(CAST(c_nationkey AS VARCHAR), 'none') AS paper_group, 'relation' AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'lead', count(*) FROM supplier GROUP BY 1""")
def findings_by_paper(spark, sf):
    """Relations and leads together, those without a paper in a group of their own"""
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("relation").alias("kind"))
    b = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("lead").alias("kind"))
    return a.unionByName(b).groupBy(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("paper_group"), "kind").agg(F.count("*").alias("n"))


@query("""SELECT 'run:' || conv_id || ':' || turn AS relation_id, role AS source, substring(text, 1, 5) AS target FROM conversations WHERE role <> '' AND length(text) >= 5""")
def adopted_claims(spark, sf):
    """Claims of a run with both ends become candidates"""
    rows = load(spark, sf, "conversations").where((F.col("role") != "") & (F.length("text") >= 5))
    return rows.select(F.concat_ws(":", F.lit("run"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("relation_id"), F.col("role").alias("source"), F.substring("text", 1, 5).alias("target"))


@query("""SELECT paper_id, CASE WHEN p = 0 THEN 'none' WHEN p = n THEN 'project' WHEN p > 0 AND p < n THEN 'mixed' END AS origin FROM (SELECT l_orderkey AS paper_id, count(*) AS n, count(*) FILTER (WHERE l_partkey % 2 = 0) AS p FROM lineitem GROUP BY 1)""")
def evidence_origin(spark, sf):
    """Where a claim's evidence comes from"""
    ids = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.collect_list("l_partkey").alias("ids"))
    inside = F.size(F.filter("ids", lambda x: x % 2 == 0))
    return ids.select("paper_id", F.when(inside == 0, "none").when(inside == F.size("ids"), "project").otherwise("mixed").alias("origin"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def stripped_pages(spark, sf):
    """X38"""
    return load(spark, sf, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@query()
def generic_relations(spark, sf):
    """Mined relations of papers without guided ones (tests hold the miner against examples)"""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return V.generic_relations(docs)


@query("""SELECT p_partkey AS relation_id, coalesce(p_size > 10, false) AND p_brand <> '' AS accepted FROM part""")
def panel_eligibility(spark, sf):
    """Relations that a panel may judge"""
    return load(spark, sf, "part").select(F.col("p_partkey").alias("relation_id"), (F.coalesce(F.col("p_size") > 10, F.lit(False)) & (F.col("p_brand") != "")).alias("accepted"))
