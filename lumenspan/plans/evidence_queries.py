"""Evidence, metrics, decision and graph queries over the driver's tables, each with its SQL where SQL can say it.

Mapping (ours): documents are papers with one body section (lang is the domain, source the publisher);
labels are two annotators; events are decision events (user_id is the claim); numbers made from synthetic
tables exercise the rules and mean nothing.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenspan.functions import metrics as M
from lumenspan.functions import text as X
from lumenspan.operators import decisions as D
from lumenspan.operators import duplicates as N
from lumenspan.operators import extraction as E
from lumenspan.operators import graph as G
from lumenspan.operators import library as L
from lumenspan.operators import reports as R
from lumenspan.sources import readers as S
from lumenspan.session import load, shared_dir, stored
from lumenspan.streaming.decisions import streamed_states, windowed_decisions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SPANS = """spans AS (SELECT doc_id AS paper_id, lang, i - 1 AS sentence_index, s AS text FROM (SELECT doc_id, lang, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)))"""


def spans(spark, sf):
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("paper_id"), "lang", F.posexplode(X.sentences(F.col("text"))).alias("sentence_index", "text"))


@query(f"""WITH {SPANS}, w AS (SELECT lang, text, count(*) AS n FROM spans GROUP BY 1, 2)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_spans, count(*) AS n_wordings, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates FROM w GROUP BY 1""")
def evidence_duplicates_by_language(spark, sf):
    """N23 same_wording, flagship: spans, distinct wordings and copies by language"""
    w = spans(spark, sf).groupBy("lang", "text").agg(F.count("*").alias("n"))
    return w.groupBy("lang").agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_wordings"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


@query(f"""WITH {SPANS} SELECT paper_id, CAST(sentence_index AS INTEGER) AS sentence_index, text, 'evidence:' || paper_id || ':' || substring(sha1('body'), 1, 14) || ':' || sentence_index AS evidence_id FROM spans""")
def evidence_spans(spark, sf):
    """N01 by the plain splitter, with evidence ids"""
    key = F.concat(F.lit("evidence:"), F.col("paper_id").cast("string"), F.lit(":"), F.substring(F.sha1(F.lit("body").cast("binary")), 1, 14), F.lit(":"), F.col("sentence_index").cast("string"))
    return spans(spark, sf).select("paper_id", "sentence_index", "text", key.alias("evidence_id"))


@query()
def evidence_spans_exact(spark, sf):
    """The full sentence splitter with offsets (a state machine; tests hold it against plain Python)"""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("body").alias("section_id"), "text")
    return E.evidence_spans(d)


CITED = "|".join(f"({p})" for p in X.CITATIONS).replace("'", "''")


@query(f"""WITH {SPANS} SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{CITED}')) AS n_citations, round(count(*) FILTER (WHERE regexp_matches(text, '{CITED}')) / count(*), 4) AS share FROM spans GROUP BY 1""")
def citation_share(spark, sf):
    """Share of citation-like sentences by domain"""
    hit = F.count(F.when(X.citation_like(F.col("text")), 1))
    return spans(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), hit.alias("n_citations"), F.round(hit / F.count("*"), 4).alias("share"))


@query(f"""WITH {SPANS}, h AS (SELECT *, regexp_matches(text, '{CITED}') AS hit FROM spans) SELECT coalesce(lang, '(all)') AS domain, count(*) AS n, count(*) FILTER (WHERE hit) AS n_citations, round(count(*) FILTER (WHERE hit) / count(*), 4) AS share FROM h GROUP BY ROLLUP (lang)""")
def citation_totals(spark, sf):
    """The share of citation-like sentences by domain and in all"""
    rows = spans(spark, sf).select("lang", X.citation_like(F.col("text")).cast("int").alias("hit"))
    out = rows.rollup("lang").agg(F.count("*").alias("n"), F.sum("hit").alias("n_citations"))
    return out.select(F.coalesce("lang", F.lit("(all)")).alias("domain"), "n", "n_citations", F.round(F.col("n_citations") / F.col("n"), 4).alias("share"))


@query(f"""WITH {SPANS}, h AS (SELECT lang AS domain, paper_id, sentence_index, left(text, 180) AS sample, row_number() OVER (PARTITION BY lang ORDER BY paper_id, sentence_index) AS place FROM spans WHERE regexp_matches(text, '{CITED}')) SELECT domain, paper_id, sentence_index::INTEGER AS sentence_index, sample, place::INTEGER AS place FROM h WHERE place <= 3""")
def citation_samples(spark, sf):
    """The first three citation-like sentences of each domain, 180 characters at most"""
    order = Window.partitionBy("domain").orderBy("paper_id", "sentence_index")
    hits = spans(spark, sf).where(X.citation_like(F.col("text"))).select(F.col("lang").alias("domain"), "paper_id", "sentence_index", F.substring("text", 1, 180).alias("sample"))
    return hits.withColumn("place", F.row_number().over(order)).where("place <= 3")


@query(f"""WITH {SPANS} SELECT text, count(*) AS n_spans, count(DISTINCT paper_id) AS n_papers, min(paper_id) AS first_paper FROM spans GROUP BY 1 HAVING count(*) > 1""")
def same_wording_groups(spark, sf):
    """Wordings that occur more than once"""
    return spans(spark, sf).groupBy("text").agg(F.count("*").alias("n_spans"), F.countDistinct("paper_id").alias("n_papers"), F.min("paper_id").alias("first_paper")).where("n_spans > 1")


def _tokens(spark, sf):
    rows = spans(spark, sf).select((F.col("paper_id") * 1000000 + F.col("sentence_index")).alias("evidence_id"), "paper_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))
    return rows


TOKENS = f"""{SPANS}, t AS (SELECT paper_id * 1000000 + sentence_index AS evidence_id, paper_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM spans),
w AS (SELECT tokens, min(evidence_id) AS wording_id, count(*) AS n_spans FROM t WHERE len(tokens) > 0 GROUP BY 1),
runs AS (SELECT DISTINCT wording_id, run FROM (SELECT wording_id, unnest(CASE WHEN len(tokens) <= 5 THEN [array_to_string(tokens, ' ')] ELSE list_transform(range(1, len(tokens) - 3), lambda i: array_to_string(list_slice(tokens, i, i + 4), ' ')) END) AS run FROM w)),
post AS (SELECT r.* FROM runs r JOIN (SELECT run FROM runs GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200) USING (run)),
pair AS (SELECT a.wording_id AS left_id, b.wording_id AS right_id FROM post a JOIN post b USING (run) WHERE a.wording_id < b.wording_id GROUP BY 1, 2 HAVING count(*) >= 3),
size AS (SELECT wording_id, count(*) AS n FROM runs GROUP BY 1),
shared AS (SELECT left_id, right_id, count(*) AS n FROM pair JOIN runs a ON a.wording_id = left_id JOIN runs b ON b.wording_id = right_id AND a.run = b.run GROUP BY 1, 2),
sim AS (SELECT left_id, right_id, round(s.n / (x.n + y.n - s.n), 6) AS similarity, s.n / (x.n + y.n - s.n) AS exact FROM shared s JOIN size x ON x.wording_id = left_id JOIN size y ON y.wording_id = right_id)"""


@query(f"""WITH {TOKENS} SELECT left_id, right_id, similarity, CASE WHEN exact >= 0.6 THEN 'near_duplicate' WHEN exact >= 0.3 THEN 'paraphrase' ELSE 'distinct' END AS verdict FROM sim""")
def near_duplicate_pairs(spark, sf):
    """Pairs of wordings by the overlap of their runs of five tokens"""
    return N.near_pairs(N.wordings(_tokens(spark, sf)))


def _clusters(spark, sf):
    rows = stored(_tokens(spark, sf), "tokens")
    return rows, N.clusters(rows, N.near_pairs(N.wordings(rows)))


COMPONENTS = f"""WITH RECURSIVE {TOKENS}, e AS MATERIALIZED (SELECT left_id AS a, right_id AS b FROM sim WHERE exact >= 0.6 UNION SELECT right_id, left_id FROM sim WHERE exact >= 0.6),
walk(a, b) AS (SELECT a, b FROM e UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a),
root AS (SELECT a AS wording_id, least(a, min(b)) AS root FROM walk GROUP BY 1),
m AS (SELECT t.evidence_id, t.paper_id, 'dup:' || coalesce(r.root, w.wording_id) AS cluster FROM t JOIN w USING (tokens) LEFT JOIN root r USING (wording_id) WHERE r.root IS NOT NULL OR w.n_spans > 1)"""


@query(f"{COMPONENTS} SELECT evidence_id, cluster FROM m")
def duplicate_clusters(spark, sf):
    """Components of equal and near-duplicate evidence"""
    return _clusters(spark, sf)[1]


@query(f"""{COMPONENTS}, li AS (SELECT cluster, min(evidence_id) AS left_id, list_sort(list(evidence_id))[2] AS right_id, 1.0::DOUBLE AS similarity FROM m JOIN t USING (evidence_id) GROUP BY cluster, tokens HAVING count(*) > 1
  UNION ALL SELECT cluster, left_id, right_id, similarity FROM sim JOIN m ON m.evidence_id = left_id WHERE exact >= 0.6)
SELECT cluster, n_members, n_papers, b.l AS left_id, b.r AS right_id, -b.s AS max_similarity, least_s AS min_similarity, n_links FROM (SELECT cluster, count(*) AS n_members, count(DISTINCT paper_id) AS n_papers FROM m GROUP BY 1)
JOIN (SELECT cluster, min({{'s': -similarity, 'l': left_id, 'r': right_id}}) AS b, min(similarity) AS least_s, count(*) AS n_links FROM li GROUP BY 1) USING (cluster)""")
def cluster_reports(spark, sf):
    """Seed, greatest and least similarity of each cluster"""
    rows = stored(_tokens(spark, sf), "tokens")
    pairs = stored(N.near_pairs(N.wordings(rows)), "pairs")
    return N.cluster_reports(rows, pairs, stored(N.clusters(rows, pairs), "clusters"))


UNITS = f"""{COMPONENTS}, pc AS MATERIALIZED (SELECT DISTINCT paper_id, cluster FROM m), pl AS MATERIALIZED (SELECT DISTINCT p.paper_id AS a, q.first AS b FROM pc p JOIN (SELECT cluster, min(paper_id) AS first FROM pc GROUP BY 1) q USING (cluster)),
pe AS MATERIALIZED (SELECT a, b FROM pl UNION SELECT b, a FROM pl), pw(a, b) AS (SELECT a, b FROM pe UNION SELECT pw.a, pe.b FROM pw JOIN pe ON pw.b = pe.a), pr AS (SELECT a AS paper_id, min(b) AS unit FROM pw GROUP BY 1),
df AS (SELECT d.source AS concept, count(DISTINCT p.paper_id) AS raw_df, count(DISTINCT coalesce(pr.unit, p.paper_id)) AS independent_df FROM (SELECT DISTINCT paper_id FROM t) p JOIN documents d ON d.doc_id = p.paper_id LEFT JOIN pr ON pr.paper_id = p.paper_id GROUP BY 1)"""


def _df(spark, sf):
    rows, members = _clusters(spark, sf)
    units = N.independent_papers(rows.select("evidence_id", "paper_id"), members)
    concepts = load(spark, sf, "documents").select(F.col("source").alias("concept"), F.col("doc_id").alias("paper_id"))
    return N.document_frequency(concepts, units)


@query(f"{UNITS} SELECT concept, raw_df, independent_df, raw_df - independent_df AS duplicate_df FROM df")
def independent_df(spark, sf):
    """Document frequency of each publisher's name, raw and with copies counted once (tests hold it against plain Python)"""
    return _df(spark, sf)


@query(f"""{UNITS} SELECT count(*) AS n_concepts, CAST(coalesce(sum(raw_df), 0) AS BIGINT) AS raw_df_total, CAST(coalesce(sum(independent_df), 0) AS BIGINT) AS independent_df_total, round(CASE WHEN sum(raw_df) > 0 THEN 1 - sum(independent_df) / sum(raw_df) ELSE 0 END, 6) AS drop_ratio FROM df""")
def df_summary(spark, sf):
    """Totals and the share that copies make up"""
    return N.frequency_summary(_df(spark, sf))


@query("""WITH b AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS r FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
d AS (SELECT DISTINCT doc_id, run FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS run FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)))
SELECT item_id, doc_id, round(count(*) / any_value(len(r)), 6) AS containment FROM (SELECT item_id, r, unnest(r) AS run FROM b) x JOIN d USING (run) GROUP BY 1, 2 HAVING count(*) / any_value(len(r)) >= 0.5""")
def benchmark_containment(spark, sf):
    """Benchmark items of whose runs at least half are in a document; benchmark is a small table of fixed size"""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    items = load(spark, sf, "benchmark").select("item_id", X.shingles(tokens).alias("r")).select("item_id", F.size("r").alias("n"), F.explode("r").alias("run"))
    rows = load(spark, sf, "documents").select("doc_id", F.explode(X.shingles(tokens)).alias("run"))
    found = rows.join(items, "run").groupBy("item_id", "doc_id").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    return found.where(F.col("k") / F.col("n") >= 0.5).select("item_id", "doc_id", F.round(F.col("k") / F.col("n"), 6).alias("containment"))


# Concepts are a short dictionary of ours: common words of the corpus's four languages.
CONCEPTS = ("and", "the", "that", "with", "und", "die", "der", "les", "que", "los", "para", "una")


def _mentions(spark, sf):
    rows = spans(spark, sf).select((F.col("paper_id") * 1000000 + F.col("sentence_index")).alias("evidence_id"), "paper_id", F.split(F.lower("text"), "[^a-z]+").alias("w"))
    return rows.select("evidence_id", "paper_id", F.posexplode("w").alias("char_start", "concept")).where(F.col("concept").isin(*CONCEPTS))


MENTIONS = f"""{SPANS}, tk AS (SELECT paper_id * 1000000 + sentence_index AS evidence_id, paper_id, unnest(l) AS concept, generate_subscripts(l, 1) - 1 AS char_start FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z]+') AS l FROM spans)),
mention AS (SELECT * FROM tk WHERE concept IN ({", ".join(repr(c) for c in CONCEPTS)})), once AS (SELECT evidence_id, paper_id, concept, min(char_start) AS char_start FROM mention GROUP BY 1, 2, 3)"""


@query(f"WITH {MENTIONS} SELECT evidence_id, paper_id, concept, CAST(char_start AS INTEGER) AS char_start FROM once")
def mentions_first(spark, sf):
    """The first mention of each concept in each sentence"""
    return E.first_mentions(_mentions(spark, sf)).select("evidence_id", "paper_id", "concept", "char_start")


@query(f"WITH {MENTIONS} SELECT concept, count(DISTINCT evidence_id) AS n_evidence, round(least(0.99, 0.78 + 0.04 * (count(DISTINCT evidence_id) - 1)), 6)::DOUBLE AS confidence FROM mention GROUP BY 1")
def entity_confidence(spark, sf):
    """A05"""
    return E.entities(_mentions(spark, sf))


RELATIONS = f"""{MENTIONS}, trig AS (SELECT paper_id * 1000000 + sentence_index AS evidence_id, 'REPORTS' AS type FROM spans WHERE contains(lower(text), 'tion')),
rel AS (SELECT a.concept AS source, b.concept AS target, coalesce(type, 'RELATED_TO') AS type, count(DISTINCT a.evidence_id) AS n_evidence FROM once a JOIN once b ON a.evidence_id = b.evidence_id AND a.char_start < b.char_start LEFT JOIN trig ON trig.evidence_id = a.evidence_id GROUP BY 1, 2, 3),
scored AS (SELECT *, round(least(0.96, (CASE WHEN type = 'RELATED_TO' THEN 0.62 ELSE 0.78 END) + 0.03 * n_evidence * (n_evidence - 1) / 2), 6)::DOUBLE AS confidence FROM rel)"""


def _relations(spark, sf):
    triggered = spans(spark, sf).where(F.lower("text").contains("tion")).select((F.col("paper_id") * 1000000 + F.col("sentence_index")).alias("evidence_id"), F.lit("REPORTS").alias("type"))
    return E.cooccurrence(_mentions(spark, sf), triggered)


@query(f"WITH {RELATIONS} SELECT source, target, type, n_evidence, confidence FROM scored")
def cooccurrence_relations(spark, sf):
    """N04 (legacy pairing), A06, J12: typed relations between concepts of one sentence"""
    return _relations(spark, sf)


@query(f"WITH {RELATIONS} SELECT source, target, type, CASE WHEN type <> 'RELATED_TO' AND confidence >= 0.72 THEN 'accepted' ELSE 'needs_review' END AS status FROM scored")
def adjudicated_relations(spark, sf):
    """Faults and status of relations"""
    rows = _relations(spark, sf).select(F.concat_ws(">", "source", "target", "type").alias("relation_id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("METHOD").alias("source_type"), F.lit("TASK").alias("target_type"), "type", "n_evidence", "confidence", "source", "target")
    schema = spark.createDataFrame([("REPORTS", ["METHOD"], ["TASK"]), ("RELATED_TO", ["METHOD"], ["TASK"])], "type string, sources array<string>, targets array<string>")
    return D.criticisms(rows, schema).select("source", "target", "type", "status")


@query(f"""WITH RECURSIVE {RELATIONS}, ed AS MATERIALIZED (SELECT source AS a, target AS b FROM scored WHERE type = 'REPORTS' AND n_evidence >= 20 UNION SELECT target, source FROM scored WHERE type = 'REPORTS' AND n_evidence >= 20),
wk(a, b) AS (SELECT a, b FROM ed UNION SELECT wk.a, ed.b FROM wk JOIN ed ON wk.b = ed.a), nodes AS (SELECT DISTINCT concept AS node FROM mention)
SELECT node, coalesce(least(node, min(b)), node) AS community FROM nodes LEFT JOIN wk ON wk.a = node GROUP BY 1""")
def communities(spark, sf):
    """Components of accepted relations; lone concepts stay"""
    edges = _relations(spark, sf).where("type = 'REPORTS' AND n_evidence >= 20").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return E.communities(_mentions(spark, sf).select(F.col("concept").alias("node")).distinct(), edges)


@query(f"""WITH {MENTIONS} SELECT (SELECT count(*) FROM spans) AS n_spans, count(DISTINCT evidence_id) AS n_hit, round(count(DISTINCT evidence_id) / (SELECT count(*) FROM spans), 6) AS coverage FROM mention""")
def extraction_audit(spark, sf):
    """Spans with a mention"""
    rows = spans(spark, sf).select((F.col("paper_id") * 1000000 + F.col("sentence_index")).alias("evidence_id"))
    return E.audit(rows, _mentions(spark, sf))


@query("""SELECT page_id, len(regexp_extract_all(lower(html), '<h[1-6][ >]')) AS n_headings FROM pages""")
def html_headings(spark, sf):
    """S04 on raw pages: headings"""
    return load(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all(F.lower("html"), F.lit("<h[1-6][ >]"), F.lit(0))).cast("long").alias("n_headings"))


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '(?i)(<h[1-6][ >])', chr(1) || '\1', 'g'), chr(1)) AS l FROM pages), u AS (SELECT page_id, unnest(CASE WHEN l[1] = '' AND len(l) > 1 THEN l[2:] ELSE l END) AS part, generate_subscripts(CASE WHEN l[1] = '' AND len(l) > 1 THEN l[2:] ELSE l END, 1) - 1 AS section_ord FROM p),
c AS (SELECT page_id, section_ord, trim(regexp_replace(regexp_replace(regexp_extract(part, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading, trim(regexp_replace(regexp_replace(regexp_replace(part, '(?is)^<h[1-6][^>]*>.*?</h[1-6]>', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, section_ord::INTEGER AS section_ord, heading, text FROM c WHERE heading <> '' OR text <> ''""")
def html_sections(spark, sf):
    """Sections of raw pages"""
    return S.html_sections(load(spark, sf, "pages"))


# Metrics.


@query("""WITH g AS (SELECT l_returnflag AS grp, count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS k FROM lineitem GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM g)
SELECT grp, n, k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM p""")
def wilson_by_group(spark, sf):
    """A08"""
    g = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_quantity") > 45, 1)).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("grp", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH g AS (SELECT l_linestatus AS grp, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.08) AS k FROM lineitem GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM g)
SELECT grp, n, k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 3) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 3) AS high FROM p""")
def wilson_ablation(spark, sf):
    """A09"""
    g = load(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("grp")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_discount") > 0.08, 1)).alias("k"))
    low, high = M.wilson_ablation(F.col("k"), F.col("n"))
    return g.select("grp", "n", "k", low.alias("low"), high.alias("high"))


@query("""WITH b AS (SELECT CAST(quality AS VARCHAR) AS x, CAST(toxic AS VARCHAR) AS y FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS s FROM b),
e AS (SELECT sum(p.n * q.n) AS ab FROM (SELECT x, count(*) AS n FROM b GROUP BY 1) p JOIN (SELECT y, count(*) AS n FROM b GROUP BY 1) q ON x = y)
SELECT n, round(s / n, 6) AS observed, round(ab / (n * n), 6) AS expected, round((s / n - ab / (n * n)) / (1 - ab / (n * n)), 6) AS kappa FROM n, e""")
def cohen_kappa(spark, sf):
    """A10"""
    return R.kappa(load(spark, sf, "labels").select(F.col("quality").cast("string").alias("label_1"), F.col("toxic").cast("string").alias("label_2")))


@query("""WITH s AS (SELECT CASE WHEN d.n_chars > 1000 THEN 'accepted' ELSE 'needs_review' END AS status, CASE WHEN d.n_chars < 300 THEN 'INSUFFICIENT' WHEN toxic = 1 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS label, quality = 0 AS error FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label <> 'INSUFFICIENT' AND status = 'accepted') AS a, count(*) FILTER (WHERE label <> 'INSUFFICIENT' AND status = 'accepted' AND (label = 'UNSUPPORTED' OR error)) AS w, count(*) FILTER (WHERE label = 'INSUFFICIENT') AS i FROM s), p AS (SELECT *, w / a AS p, 1.959963984540054::DOUBLE AS z FROM c),
q AS (SELECT *, greatest(0, (p + z * z / (2 * a) - z * sqrt(p * (1 - p) / a + z * z / (4.0 * a * a))) / (1 + z * z / a)) AS lo, least(1, (p + z * z / (2 * a) + z * sqrt(p * (1 - p) / a + z * z / (4.0 * a * a))) / (1 + z * z / a)) AS hi FROM p)
SELECT n, a AS n_accepted, w AS n_wrong, i AS n_insufficient, round(p, 6) AS rate, round(lo, 6) AS low, round(hi, 6) AS high, round(i / n, 6) AS insufficient_ratio, hi < 0.05 AND a >= 73 AND i / n <= 0.10 AS passes FROM q""")
def hallucination_report(spark, sf):
    """A11"""
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    label = F.when(F.col("n_chars") < 300, "INSUFFICIENT").when(F.col("toxic") == 1, "UNSUPPORTED").otherwise("SUPPORTED")
    return R.hallucination(rows.select(F.when(F.col("n_chars") > 1000, "accepted").otherwise("needs_review").alias("status"), label.alias("label"), (F.col("quality") == 0).alias("error")))


@query("""WITH r AS (SELECT o_orderkey AS path_id, abs(o_orderkey % 6 - o_custkey % 5) AS gap, list_distinct(['a', 'b', 'c', 'd' || (o_orderkey % 3)]) AS req, ['a', 'b', 'd1', 'c' || (o_custkey % 2)] AS cov, ['x', 'y' || (o_orderkey % 2)] AS mas, ['x' || (o_custkey % 4), 'y1', 'z', 'q', 'p'] AS tar FROM orders)
SELECT path_id, gap, round(len(list_intersect(req, cov)) / len(req), 6) AS coverage, round(len(list_intersect(tar, mas)) / len(tar), 6) AS mastered_share, gap <= 1 AND len(list_intersect(req, cov)) / len(req) >= 0.8 AND len(list_intersect(tar, mas)) / len(tar) <= 0.2 AS suitable FROM r""")
def adaptation_rule(spark, sf):
    """Is a path's difficulty right for a learner?"""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    arr = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    rows = load(spark, sf, "orders").select(o.alias("path_id"), (o % 6).alias("expected"), (c % 5).alias("target"), arr("a", "b", "c", name("d", o % 3)).alias("required"), arr("a", "b", "d1", name("c", c % 2)).alias("covered"), arr("x", name("y", o % 2)).alias("mastered"), arr(name("x", c % 4), "y1", "z", "q", "p").alias("targets"))
    return R.adaptation(rows)


@query("""WITH pt AS (SELECT p_partkey AS point_id, CASE WHEN p_size % 9 = 0 THEN '(no domain)' ELSE p_brand END AS domain FROM part), nm AS (SELECT p_partkey AS point_id, lower(trim(p_name)) AS k FROM part UNION SELECT p_partkey, lower(p_type) FROM part WHERE p_partkey % 3 = 0),
h AS (SELECT CASE WHEN l_linenumber > 2 THEN -l_partkey ELSE l_partkey END AS point_id, CASE WHEN l_linenumber > 5 THEN lower(p_type) ELSE lower(trim(p_name)) END AS k, l_suppkey AS paper_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 3 OR l_quantity > 49),
a AS (SELECT h.point_id, paper_id FROM h JOIN pt USING (point_id) UNION ALL SELECT nm.point_id, paper_id FROM h JOIN nm USING (k) WHERE h.point_id NOT IN (SELECT point_id FROM pt)), c AS (SELECT point_id, count(DISTINCT paper_id) AS n FROM a GROUP BY 1)
SELECT domain, count(*) AS n_points, count(*) FILTER (WHERE n >= 1) AS n_loose, count(*) FILTER (WHERE n >= 2) AS n_strict, round(count(*) FILTER (WHERE n >= 1) / count(*), 6) AS loose, round(count(*) FILTER (WHERE n >= 2) / count(*), 6) AS strict FROM pt LEFT JOIN c USING (point_id) GROUP BY 1""")
def coverage_by_domain(spark, sf):
    """Knowledge points, some with two names, with a paper, and with two different ones"""
    p = load(spark, sf, "part")
    domain = F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("domain")
    points = p.select(F.col("p_partkey").alias("point_id"), F.col("p_name").alias("name"), domain).unionByName(p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("point_id"), F.col("p_type").alias("name"), domain))
    hits = load(spark, sf, "lineitem").where("l_linenumber <> 3 OR l_quantity > 49").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    hits = hits.select(F.when(F.col("l_linenumber") > 2, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("point_id"), F.when(F.col("l_linenumber") > 5, F.col("p_type")).otherwise(F.col("p_name")).alias("name"), F.col("l_suppkey").alias("paper_id"))
    return R.coverage(points, hits)


@query("""WITH c AS (SELECT source, doc_id, n_chars FROM documents) SELECT count(*) AS pool, count(*) FILTER (WHERE source <> 'src3' AND doc_id % 7 <> 0 AND n_chars > 200) AS n_real, count(*) FILTER (WHERE source <> 'src3' AND doc_id % 7 <> 0 AND n_chars > 200) >= 50 AS passes FROM c""")
def real_case_count(spark, sf):
    """A15, P03"""
    d = load(spark, sf, "documents")
    rows = d.select(F.when(F.col("source") == "src3", "synthetic").otherwise(F.col("source")).alias("source"), F.col("doc_id").cast("string").alias("paper_id"), F.when(F.col("doc_id") % 7 != 0, "page-001").alias("page"), F.lit(0).alias("char_start"), (F.col("n_chars") - 200).alias("char_end"), F.lit("q").alias("quote"))
    return R.real_cases(rows)


VARIANTS = """v AS (SELECT doc_id, unnest(['rule', 'single_pass', 'vote', 'triad']) AS variant, 0.5 + (n_chars % 50) / 100 AS c, quality = 1 AS valid, 0.6 + (d.doc_id % 40) / 100 AS s, toxic = 0 AS gold FROM labels JOIN documents d USING (doc_id)),
a AS (SELECT doc_id, variant, gold, CASE variant WHEN 'rule' THEN c >= 0.78 WHEN 'single_pass' THEN valid AND c >= 0.72 WHEN 'vote' THEN valid AND (c >= 0.70)::INT + (c >= 0.72)::INT + (c >= 0.74)::INT >= 2 ELSE valid AND s >= 0.78 END AS accepted FROM v)"""


@query(f"""WITH {VARIANTS}, n AS (SELECT variant, count(*) FILTER (WHERE accepted AND gold) AS tp, count(*) FILTER (WHERE accepted AND NOT gold) AS fp, count(*) FILTER (WHERE NOT accepted AND gold) AS fn FROM a GROUP BY 1)
SELECT variant, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM n""")
def decision_variants(spark, sf):
    """Decision rules against a gold label"""
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    claims = rows.select(F.col("doc_id").alias("claim_id"), (0.5 + (F.col("n_chars") % 50) / 100).alias("confidence"), (F.col("quality") == 1).alias("valid"), (0.6 + (F.col("doc_id") % 40) / 100).alias("triad_score"))
    return R.variant_metrics(D.variants(claims).join(rows.select(F.col("doc_id").alias("claim_id"), (F.col("toxic") == 0).alias("gold")), "claim_id"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(max(value) FILTER (WHERE i = least(n - 1, greatest(0, round_even(0.95 * n + 0.5, 0) - 1))), 6) AS p95, round(count(*) / nullif(sum(value), 0), 6) AS rate FROM o GROUP BY 1""")
def experiment_timing(spark, sf):
    """Timing by variant, with the p95 of the index formula"""
    return R.timing_large(load(spark, sf, "events").select("event_type", "value"), "event_type", "value")


@query("""WITH d AS (SELECT *, 2015 + doc_id % 10 AS year, n_chars > 2000 AS a FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (WHERE a) AS n_a, min(year) AS first_year, max(year) AS last_year, round(avg(year), 4) AS mean_year FROM d GROUP BY 1""")
def literature_stats(spark, sf):
    """A26"""
    year = 2015 + F.col("doc_id") % 10
    return load(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_chars") > 2000, 1)).alias("n_a"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.round(F.avg(year), 4).alias("mean_year"))


@query(f"""WITH {MENTIONS}, pcn AS (SELECT DISTINCT paper_id, concept FROM mention), cdf AS (SELECT concept, count(*) AS df FROM pcn GROUP BY 1 ORDER BY df DESC, concept LIMIT 5), best AS (SELECT paper_id, concept AS anchor FROM (SELECT paper_id, concept, row_number() OVER (PARTITION BY paper_id ORDER BY df DESC, concept) AS r FROM pcn JOIN cdf USING (concept)) WHERE r = 1)
SELECT coalesce(anchor, (SELECT concept FROM cdf ORDER BY df DESC, concept LIMIT 1)) AS anchor, count(*) AS n_papers, round(avg(2015 + doc_id % 10), 4) AS avg_year FROM documents LEFT JOIN best ON paper_id = doc_id GROUP BY 1""")
def topic_clusters(spark, sf):
    """A27"""
    papers = load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), (2015 + F.col("doc_id") % 10).alias("year"))
    return R.topic_clusters(_mentions(spark, sf).select("paper_id", "concept").distinct(), papers, 5)


@query("""WITH c AS (SELECT p_brand AS s, p_type AS t, CAST(p_size % 4 AS VARCHAR) AS r FROM part), g AS (SELECT least(s, t) AS a, greatest(s, t) AS b, count(DISTINCT r) AS n_relations, array_to_string(list_sort(list_distinct(list(r))), '|') AS relations FROM c GROUP BY 1, 2) SELECT * FROM g WHERE n_relations > 1""")
def controversies(spark, sf):
    """A28"""
    return G.controversies(load(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("target"), (F.col("p_size") % 4).cast("string").alias("relation")))


# Graph.


def _edges(spark, sf):
    return load(spark, sf, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.lit("USES").alias("type"), (F.col("p_retailprice") / 10000).alias("confidence")).groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


EDGES = "e AS (SELECT p_brand AS a, p_type AS b, max(p_retailprice / 10000) AS c FROM part GROUP BY 1, 2), u AS (SELECT a, b, c FROM e UNION ALL SELECT b, a, c FROM e), s AS (SELECT min(p_brand) AS node FROM part)"


@query(f"""WITH {EDGES}, one AS (SELECT DISTINCT b AS node FROM u JOIN s ON a = s.node), two AS (SELECT DISTINCT b AS node FROM u JOIN one ON a = one.node)
SELECT node, 0 AS depth FROM s UNION ALL SELECT node, 1 FROM one WHERE node NOT IN (SELECT node FROM s) UNION ALL SELECT node, 2 FROM two WHERE node NOT IN (SELECT node FROM one) AND node NOT IN (SELECT node FROM s)""")
def bfs_two_hop(spark, sf):
    """What two steps reach"""
    edges = _edges(spark, sf)
    return G.reach(edges, edges.agg(F.min("src").alias("node")), depth=2)


@query(f"""WITH {EDGES}, p1 AS (SELECT [a, b] AS path, c AS t FROM u JOIN s ON a = s.node), p2 AS (SELECT list_append(path, b) AS path, t + c AS t FROM p1 JOIN u ON u.a = path[-1] WHERE NOT list_contains(path, b)), p3 AS (SELECT list_append(path, b) AS path, t + c AS t FROM p2 JOIN u ON u.a = path[-1] WHERE NOT list_contains(path, b)),
al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3), r AS (SELECT path, len(path) - 1 AS n_edges, round(max(t) + 0.15 * (len(path) - 1), 6) AS score FROM al GROUP BY 1, 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 6)
SELECT array_to_string(path, ' > ') AS path, n_edges, score FROM r""")
def simple_paths(spark, sf):
    """G03"""
    edges = _edges(spark, sf)
    return G.simple_paths(edges, edges.agg(F.min("src").alias("node"))).withColumn("path", F.array_join("path", " > "))


@query(f"WITH {EDGES} SELECT a AS node, count(*) AS degree FROM u GROUP BY 1")
def node_degrees(spark, sf):
    """A23, G05"""
    return G.degrees(_edges(spark, sf))


@query("""WITH l AS (SELECT o_custkey AS paper_id, 2 * l_discount AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, 0.35 FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT paper_id, sum(w) AS w FROM l GROUP BY 1)
SELECT paper_id, round(w + 0.4 * len(list_intersect(list_distinct(regexp_split_to_array(lower(c_mktsegment), '[^a-z]+')), ['building', 'machinery'])) + 0.01 * greatest(0, 2015 + c_custkey % 12 - 2020), 6) AS score FROM b JOIN customer ON c_custkey = paper_id ORDER BY score DESC, paper_id LIMIT 5""")
def paper_recommendation(spark, sf):
    """A17, J16"""
    o = load(spark, sf, "orders")
    linked = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("paper_id"), F.col("l_discount").alias("confidence"))
    papers = load(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_mktsegment").alias("text"), (2015 + F.col("c_custkey") % 12).alias("year"))
    return G.recommend(linked, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("paper_id")), papers, ["building", "machinery"])


@query("""WITH c AS (SELECT p_partkey AS claim_id, CASE WHEN p_size = 7 THEN 'proves' ELSE 'uses' END AS relation, 0.5 + (p_partkey % 45) / 100 AS conf, p_size % 11 = 0 AS flagged, p_size % 13 = 0 AS blocked FROM part),
e AS (SELECT l_partkey AS claim_id, count(*) AS n, count(DISTINCT l_suppkey) AS p, count(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END) AS a FROM lineitem GROUP BY 1),
s AS (SELECT c.*, coalesce(n, 0) AS n, round(greatest(0, least(0.99, conf + least(0.10, 0.05 * coalesce(n, 0)) + (CASE WHEN coalesce(p, 0) >= 2 THEN 0.05 ELSE 0 END) + least(0.09, 0.03 * coalesce(a, 0)) - ((CASE WHEN coalesce(n, 0) = 0 THEN 0.45 ELSE 0 END) + (CASE WHEN relation = 'proves' THEN 0.45 ELSE 0 END) + (CASE WHEN conf < 0.7 THEN 0.08 ELSE 0 END) + (CASE WHEN flagged THEN 0.32 ELSE 0 END)))), 6)::DOUBLE AS score FROM c LEFT JOIN e USING (claim_id))
SELECT claim_id, n AS n_evidence, score, CASE WHEN score >= 0.78 AND NOT (blocked OR relation = 'proves' OR n = 0) THEN 'accepted' WHEN score >= 0.58 AND n > 0 THEN 'needs_review' ELSE 'rejected' END AS status FROM s""")
def judge_scores(spark, sf):
    """N17"""
    claims = load(spark, sf, "part").select(F.col("p_partkey").alias("claim_id"), F.when(F.col("p_size") == 7, "proves").otherwise("uses").alias("relation"), (0.5 + (F.col("p_partkey") % 45) / 100).alias("confidence"), (F.col("p_size") % 11 == 0).alias("flagged"), (F.col("p_size") % 13 == 0).alias("blocked"))
    spans_ = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("claim_id"), F.col("l_suppkey").alias("paper_id"), (F.col("l_suppkey") % 3 == 0).alias("grade_a"))
    return D.judged(claims, spans_)


# Decision events.


def _events(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "signup"), "add_support").when(F.col("event_type") == "click", "replace_span").when(F.col("event_type") == "error", "delete_evidence").otherwise("add_refute")
    return load(spark, sf, "events").select(
        F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("arrival"), kind.alias("event_type"), F.lit("critic").alias("actor"), F.get_json_object("props", "$.k").alias("evidence_id"),
        (F.col("event_id") % 7).cast("string").alias("source"), (F.col("value") > 5).alias("replace_valid"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("override_status"), "ts")


def _claims(spark, sf):
    k = F.col("claim_id") % 3
    return load(spark, sf, "events").select(F.col("user_id").alias("claim_id")).distinct().withColumn("strength", F.when(k == 0, "plain").when(k == 1, "progressive").otherwise("absolute"))


EVENTS = """ev AS (SELECT user_id AS claim_id, event_id AS seq, CASE WHEN event_type IN ('view', 'signup') THEN 'add_support' WHEN event_type = 'click' THEN 'replace_span' WHEN event_type = 'error' THEN 'delete_evidence' ELSE 'add_refute' END AS kind, json_extract_string(props, '$.k') AS evidence_id, CAST(event_id % 7 AS VARCHAR) AS source, value > 5 AS ok FROM events),
cut AS (SELECT *, max(CASE WHEN kind = 'delete_evidence' OR (kind = 'replace_span' AND NOT coalesce(ok, false)) THEN seq END) OVER (PARTITION BY claim_id, evidence_id) AS r FROM ev WHERE evidence_id IS NOT NULL),
alive AS (SELECT claim_id, evidence_id, coalesce(arg_max(kind, seq) FILTER (WHERE kind IN ('add_support', 'add_refute')), 'add_support') AS kind, arg_max(source, seq) AS source FROM cut WHERE r IS NULL OR seq > r GROUP BY 1, 2)"""


@query(f"WITH {EVENTS} SELECT claim_id, evidence_id, kind, source FROM alive")
def valid_evidence(spark, sf):
    """E02"""
    return D.valid_evidence(_events(spark, sf))


@query(f"""WITH {EVENTS}, n AS (SELECT claim_id, count(*) FILTER (WHERE kind = 'add_support') AS s, count(*) FILTER (WHERE kind = 'add_refute') AS r, count(DISTINCT CASE WHEN kind = 'add_support' AND source <> '' THEN source END) AS k FROM alive GROUP BY 1)
SELECT c.claim_id, CASE WHEN coalesce(s, 0) + coalesce(r, 0) = 0 THEN 'rejected' WHEN c.claim_id % 3 = 2 AND coalesce(k, 0) < 2 THEN 'rejected' WHEN coalesce(s, 0) = 0 THEN 'rejected' WHEN r > 0 THEN 'needs_review' WHEN k >= 2 THEN 'accepted' ELSE 'needs_review' END AS status, coalesce(s, 0) AS n_support, coalesce(r, 0) AS n_refute, coalesce(k, 0) AS n_sources
FROM (SELECT DISTINCT user_id AS claim_id FROM events) c LEFT JOIN n ON n.claim_id = c.claim_id""")
def easg_projection(spark, sf):
    """Claim states from the whole event log"""
    return D.projection(_events(spark, sf), _claims(spark, sf)).select("claim_id", "status", "n_support", "n_refute", "n_sources")


LOG = """ev AS (SELECT user_id AS claim_id, event_id AS seq, CASE event_id % 13 WHEN 0 THEN 'human_override' WHEN 1 THEN 'add_superseding' WHEN 2 THEN 'delete_evidence' WHEN 3 THEN 'replace_span' WHEN 4 THEN 'add_refute' WHEN 5 THEN 'delete_evidence' ELSE 'add_support' END AS kind,
  'e' || (event_id % 4) AS evidence_id, CASE WHEN event_id % 3 > 0 THEN 's' || (event_id % 5) ELSE '' END AS source, value > 50 AS ok, CASE WHEN event_id % 13 = 1 AND event_id % 17 > 0 THEN (user_id * 7 + event_id) % 997 END AS nxt,
  CASE WHEN event_id % 13 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END END AS override FROM events WHERE user_id % 5 < 4),
f AS (SELECT claim_id, evidence_id, coalesce(max(seq) FILTER (WHERE kind = 'delete_evidence' OR kind = 'replace_span' AND NOT coalesce(ok, false)), -1) AS ended, max({'s': seq, 'k': kind}) FILTER (WHERE kind IN ('add_support', 'add_refute')) AS added, max({'s': seq, 'x': source}) FILTER (WHERE kind IN ('add_support', 'add_refute') OR kind = 'replace_span' AND ok) AS newest FROM ev WHERE kind NOT IN ('human_override', 'add_superseding') GROUP BY 1, 2),
al AS (SELECT claim_id, evidence_id, CASE WHEN added.s > ended THEN added.k ELSE 'add_support' END AS kind, newest.x AS source FROM f WHERE newest.s > ended),
n AS (SELECT claim_id, count(*) FILTER (WHERE kind = 'add_support') AS s, count(*) FILTER (WHERE kind = 'add_refute') AS r, count(DISTINCT CASE WHEN kind = 'add_support' AND source <> '' THEN source END) AS k FROM al GROUP BY 1),
la AS (SELECT claim_id, arg_max(kind, seq) AS last, arg_max({'o': override}, seq).o AS override, arg_max(nxt, seq) FILTER (WHERE nxt IS NOT NULL) AS nxt FROM ev GROUP BY 1),
j AS (SELECT c.claim_id, last, override, coalesce(s, 0) AS s, coalesce(r, 0) AS r, coalesce(k, 0) AS k, CASE WHEN nxt IN (SELECT claim_id FROM al) THEN nxt END AS nxt, CASE c.claim_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'progressive' ELSE 'absolute' END AS strength FROM (SELECT DISTINCT user_id AS claim_id FROM events) c LEFT JOIN la ON la.claim_id = c.claim_id LEFT JOIN n ON n.claim_id = c.claim_id)
SELECT claim_id, CASE WHEN last IS NULL THEN 'candidate' WHEN last = 'human_override' THEN override WHEN nxt IS NOT NULL THEN 'superseded' WHEN s + r = 0 OR strength = 'absolute' AND k < 2 OR s = 0 THEN 'rejected' WHEN r > 0 THEN 'needs_review' WHEN k >= 2 THEN 'accepted' ELSE 'needs_review' END AS status,
  CASE WHEN s > 0 AND r > 0 THEN 'contested' WHEN r > 0 THEN 'refuted' WHEN s > 0 THEN 'supported' ELSE 'unsupported' END AS layer, CASE WHEN last IS NOT NULL AND last <> 'human_override' THEN nxt END AS superseded_by, coalesce(last = 'human_override', false) AS held,
  CASE WHEN last IS NULL THEN 'no_event' WHEN last = 'human_override' THEN 'human_override' WHEN nxt IS NOT NULL THEN 'newer_successor' WHEN s + r = 0 THEN 'no_valid_evidence' WHEN strength = 'absolute' AND k < 2 THEN 'absolute_claim_weak' WHEN s = 0 THEN 'refuted_no_support' WHEN r > 0 THEN 'contested' WHEN k >= 2 THEN 'several_sources' ELSE 'single_source' END AS reason,
  s AS n_support, r AS n_refute, k AS n_sources FROM j"""


def _log(spark, sf):
    k, user = F.col("event_id"), F.col("user_id")
    kind = F.when(k % 13 == 0, "human_override").when(k % 13 == 1, "add_superseding").when((k % 13).isin(2, 5), "delete_evidence").when(k % 13 == 3, "replace_span").when(k % 13 == 4, "add_refute").otherwise("add_support")
    return load(spark, sf, "events").where(user % 5 < 4).select(
        user.alias("claim_id"), k.alias("seq"), kind.alias("event_type"), F.when(~(k % 13).isin(0, 1), F.concat(F.lit("e"), k % 4)).alias("evidence_id"), F.when(k % 3 > 0, F.concat(F.lit("s"), k % 5)).otherwise("").alias("source"),
        (F.col("value") > 50).alias("replace_valid"), F.when((k % 13 == 1) & (k % 17 > 0), (user * 7 + k) % 997).alias("superseded_by"), F.when(k % 13 == 0, F.when(k % 2 == 0, "accepted").otherwise("rejected")).alias("override_status"))


@query(f"WITH {LOG}")
def claim_states(spark, sf):
    """Claim states with overrides and successors"""
    return D.projection(_log(spark, sf), _claims(spark, sf))


@query(f"WITH {LOG}")
def claim_states_streamed(spark, sf):
    """The same from a stream of micro-batches that come in another order than the events"""
    root = shared_dir(spark)
    log = _log(spark, sf)
    log.repartition(4, F.xxhash64("seq")).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/log")
    return streamed_states(stream, _claims(spark, sf), root)


@query(f"""WITH {EVENTS}, g AS (SELECT claim_id, arg_max(CASE kind WHEN 'add_refute' THEN 'rejected' ELSE 'accepted' END, seq) AS status FROM ev WHERE kind IN ('add_support', 'add_refute') GROUP BY 1) SELECT c.claim_id, coalesce(status, 'candidate') AS status FROM (SELECT DISTINCT user_id AS claim_id FROM events) c LEFT JOIN g ON g.claim_id = c.claim_id""")
def easg_static_baseline(spark, sf):
    """E05"""
    return D.static_baseline(_events(spark, sf), _claims(spark, sf))


@query("""SELECT user_id AS claim_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'unknown_type' WHEN user_id % 10 = 0 THEN 'unknown_claim' ELSE 'sequence' END AS reason FROM (
SELECT *, CASE WHEN event_id % 50 = 0 THEN event_id - 1000 ELSE event_id END AS s, max(CASE WHEN event_id % 50 = 0 THEN event_id - 1000 ELSE event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE event_type = 'signup' OR user_id % 10 = 0 OR s <= b""")
def event_rejects(spark, sf):
    """E01"""
    rows = _events(spark, sf).join(load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("_t")), "seq")
    rows = rows.withColumn("event_type", F.when(F.col("_t") == "signup", "x").otherwise(F.col("event_type"))).withColumn("seq", F.when(F.col("arrival") % 50 == 0, F.col("arrival") - 1000).otherwise(F.col("arrival")))
    return D.rejects(rows, _claims(spark, sf).where("claim_id % 10 <> 0")).select("claim_id", F.col("arrival").alias("seq"), "reason")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS begin, user_id AS claim_id, count(*) AS n_events, count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS n_support FROM events GROUP BY 1, 2""")
def decision_windows(spark, sf):
    """The streaming query's batch form"""
    return windowed_decisions(_events(spark, sf)).withColumn("begin", F.date_format("begin", "yyyy-MM-dd HH"))


# Text rules.

DOMAINS = [("english", (" the ", " and ", "tion")), ("german", (" der ", " und ", "keit")), ("french", (" les ", " que ", "eux")), ("spanish", (" los ", "ción", " para "))]


def _count(keys):
    return " + ".join(f"contains(lower(text), '{k}')::INT" for k in keys)


@query("WITH s AS (SELECT doc_id, " + ", ".join(f"{_count(k)} AS s{i}" for i, (_, k) in enumerate(DOMAINS)) + " FROM documents), b AS (SELECT *, greatest(s0, s1, s2, s3) AS n FROM s) SELECT doc_id, CASE WHEN n = 0 THEN 'general' " + " ".join(f"WHEN s{i} = n THEN '{d}'" for i, (d, _) in enumerate(DOMAINS)) + " END AS domain, CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, 0.45 + 0.12 * n), 3) END::DOUBLE AS confidence, n::BIGINT AS matched FROM b")
def domain_router(spark, sf):
    """X08"""
    return load(spark, sf, "documents").select("doc_id", X.route(F.col("text"), DOMAINS).alias("r")).select("doc_id", "r.*")


INTENTS = [("idea_discovery", ("idea", "gap", "new ")), ("analysis_reasoning", ("why", "compare", "cause")), ("literature_retrieval", ("paper", "find", "list"))]


@query("WITH s AS (SELECT conv_id, turn, " + ", ".join(" + ".join(f"contains(lower(trim(text)), '{k}')::INT" for k in keys) + f" AS s{i}" for i, (_, keys) in enumerate(INTENTS)) + """ FROM conversations), t AS (SELECT conv_id, turn, s0, s1, CASE WHEN s0 + s1 + s2 = 0 THEN 1 ELSE s2 END AS s2 FROM s), b AS (SELECT *, greatest(s0, s1, s2) AS n FROM t)
SELECT conv_id, turn, CASE WHEN s0 = n THEN 'idea_discovery' WHEN s1 = n THEN 'analysis_reasoning' ELSE 'literature_retrieval' END AS intent, round(least(0.98, 0.55 + 0.12 * n + 0.08 * n / greatest(1, s0 + s1 + s2)), 3)::DOUBLE AS confidence FROM b""")
def intent_router(spark, sf):
    """X09"""
    return load(spark, sf, "conversations").select("conv_id", "turn", X.intent(F.col("text"), INTENTS, "literature_retrieval").alias("r")).select("conv_id", "turn", "r.*")


def _any(markers):
    return "(" + " OR ".join(f"contains(lower(text), '{m.lower()}')" for m in markers) + ")"


@query(f"WITH {SPANS} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN {_any(X.ABSOLUTE_MARKERS)} THEN 'danger' WHEN {_any(X.PROGRESSIVE_MARKERS)} THEN 'warning' WHEN {_any(X.HEDGE_MARKERS)} THEN 'info' ELSE 'plain' END AS verdict FROM spans) GROUP BY 1")
def semantic_strength(spark, sf):
    """X10"""
    return spans(spark, sf).groupBy(X.semantic_strength(F.col("text")).alias("verdict")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT doc_id, n_chars, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN {n}" for n, p in X.DESIGN_LEVELS) + " WHEN lang = 'en' THEN 3 ELSE 5 END AS level, text FROM documents), f AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'ablation|benchmark|reproduc|open.?source|code available') THEN 'gold_standard' WHEN level <= 3 THEN 'strong' WHEN level <= 5 THEN 'moderate' ELSE 'weak' END AS fit FROM l) SELECT doc_id, level, fit, CASE WHEN level <= 4 AND fit IN ('gold_standard', 'strong') AND doc_id % 3 < 2 THEN 'A' ELSE 'B' END AS quality FROM f")
def paper_grade(spark, sf):
    """X21"""
    d = load(spark, sf, "documents").withColumn("level", X.design_level(F.col("text"), F.col("lang") == "en")).withColumn("fit", X.discipline_fit(F.col("text"), F.col("level")))
    return d.select("doc_id", "level", "fit", F.when((F.col("level") <= 4) & F.col("fit").isin("gold_standard", "strong") & (F.col("doc_id") % 3 < 2), "A").otherwise("B").alias("quality"))


@query("""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '10.1234/x.' || page_id WHEN page_id % 3 = 1 THEN 'doi ' || page_id ELSE '' END AS doi, list_slice(regexp_extract_all(lower(url), '[a-z]{4,}'), 1, 3) AS w FROM pages)
SELECT page_id, CASE WHEN regexp_full_match(doi, '10\\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+') AND len(list_filter(w, lambda x: NOT contains(lower(url), x))) = 0 THEN 'PRELIMINARY' WHEN doi <> '' AND NOT regexp_full_match(doi, '10\\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+') THEN 'MAJOR' WHEN doi = '' AND url <> '' THEN 'MINOR' ELSE 'UNVERIFIABLE' END AS status FROM p""")
def citation_check(spark, sf):
    """X22"""
    k = F.col("page_id")
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.1234/x."), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("doi "), k.cast("string"))).otherwise("")
    return load(spark, sf, "pages").select("page_id", X.citation_status(F.col("url"), F.col("url"), doi).alias("status"))


#: The singular of a word w in SQL.
PLURAL = "CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in X.IRREGULAR_PLURALS.items()) + """ WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN w[:-3] WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN w LIKE '%s' THEN w[:-2] ELSE w END"""


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT w AS word, {PLURAL} AS singular FROM t""")
def singular_words(spark, sf):
    """X05 over the corpus's words"""
    words = load(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", X.singular(F.col("word")).alias("singular"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE length(t) < 20) AS n_short, round(avg(CASE WHEN length(t) = 0 THEN 1 ELSE length(regexp_replace(t, '[\\p{L}\\s]', '', 'g')) / length(t) END), 4) AS symbols FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY 1""")
def evidence_quality(spark, sf):
    """Symbol share by publisher"""
    d = load(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.length("text") < 20, 1)).alias("n_short"), F.round(F.avg(X.symbol_ratio(F.col("text"))), 4).alias("symbols"))


@query("""WITH s AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?\n]+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x)) AS l FROM documents)
SELECT doc_id, len(l) AS n_sentences, round(coalesce(list_stddev_pop(l) / list_avg(l), 0), 4) AS variation FROM s""")
def text_signal(spark, sf):
    """How much sentence lengths vary"""
    sizes = F.transform(X.wide_sentences(F.col("text")), lambda s: F.length(s))
    d = load(spark, sf, "documents").select("doc_id", sizes.alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_sentences"), F.round(F.coalesce(X.spread(F.col("l")), F.lit(0.0)), 4).alias("variation"))


@query("""SELECT doc_id, 'entity:' || substring(sha1('entity' || chr(31) || lang || chr(31) || source), 1, 14) AS entity_id FROM documents""")
def stable_ids(spark, sf):
    """Stable ids of 14 hex digits"""
    return load(spark, sf, "documents").select("doc_id", X.stable_id("entity", F.lit("entity"), F.col("lang"), F.col("source")).alias("entity_id"))
