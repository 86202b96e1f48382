"""Text functions, mappers and small readers over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.operators import extraction as E
from lumenspan.operators import library as L
from lumenspan.operators import review as V
from lumenspan.operators import services as C
from lumenspan.plans.evidence_queries import PLURAL
from lumenspan.plans.relation_queries import DICTIONARY, FOUND, TRIGGERS, _places, _spans
from lumenspan.session import load, ship, stored
from lumenspan.sources import readers as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(coalesce(text, ''), '[\s_\-/]+', ' ', 'g')), 'ß', 'ss'), '[^\p{L}\p{N}_ ]', '', 'g'), ' +', ' ', 'g')) AS name FROM documents""")
def normalized_names(spark, sf):
    """Whole texts as names: folded, separators to spaces, other signs dropped"""
    ship(spark)
    return load(spark, sf, "documents").select("doc_id", X.normalize_name(F.coalesce("text", F.lit(""))).alias("name"))


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]+')) AS w FROM documents) GROUP BY 1""")
def token_words(spark, sf):
    """Words of the corpus"""
    return load(spark, sf, "documents").select(F.explode(X.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


STOP = ("the", "and", "of", "to", "in", "is")


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[_/\-–—]', ' ', 'g'), '[a-z][a-z'']*|[0-9]+(?:[.,][0-9]+)*%?') AS l FROM documents),
k AS (SELECT doc_id, list_transform(list_filter(list_transform(l, lambda w: trim(w, chr(39))), lambda w: w NOT IN ({", ".join(repr(w) for w in STOP)})), lambda w: CASE WHEN w[1] BETWEEN '0' AND '9' THEN w ELSE ({PLURAL}) END) AS l FROM t)
SELECT doc_id, len(l)::INTEGER AS n_words, md5(array_to_string(l, ' ')) AS words FROM k""")
def evidence_words(spark, sf):
    """Words of evidence: compatible signs and case folded, numbers whole, stop-words gone, plurals to singular"""
    ship(spark)
    found = load(spark, sf, "documents").select("doc_id", X.evidence_words(F.col("text"), STOP).alias("w"))
    return found.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


NAMES = ("知识图谱", "深度学习模型", "图谱")
_NAMED = "list_transform([1, 2, 3], lambda k: CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES, 1)) + " END)"


@query(f"""WITH d AS (SELECT doc_id, {_NAMED}[doc_id % 3 + 1] || CASE WHEN doc_id % 2 = 0 THEN '的' ELSE ' ' END || {_NAMED}[(doc_id + 1) % 3 + 1] AS t FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(t, '[一-鿿]{{2,}}')) AS r FROM d), g AS (SELECT doc_id, r AS g FROM r UNION SELECT doc_id, substr(r, i, n) FROM (SELECT *, unnest(range(1, length(r) - n + 2)) AS i FROM (SELECT *, unnest(range(2, least(6, length(r)) + 1)) AS n FROM r)))
SELECT doc_id, count(*) AS n_grams, min(g) AS first, max(g) AS last FROM g GROUP BY 1""")
def chinese_grams(spark, sf):
    """Chinese runs and their n-grams in names put together for each document"""
    k, names = F.col("doc_id"), F.array(*map(F.lit, NAMES))
    text = F.concat(F.get(names, (k % 3).cast("int")), F.when(k % 2 == 0, "的").otherwise(" "), F.get(names, ((k + 1) % 3).cast("int")))
    grams = X.cjk_grams(text)
    return load(spark, sf, "documents").select("doc_id", F.size(grams).cast("long").alias("n_grams"), F.array_min(grams).alias("first"), F.array_max(grams).alias("last"))


@query("""SELECT doc_id, substr(text, greatest(0, k - 100) + 1, least(length(text), k + 140) - greatest(0, k - 100)) AS around FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id * 7 % greatest(1, length(coalesce(text, ''))) AS k FROM documents)""")
def contexts(spark, sf):
    """Text around a place of each document"""
    at = F.col("doc_id") * 7 % F.greatest(F.lit(1), F.length("text"))
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", at)
    return d.select("doc_id", X.context(F.col("text"), F.col("k").cast("int"), (F.col("k") + 40).cast("int"), 100).alias("around"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def json_answers(spark, sf):
    """The object inside an answer: fenced, inside words, bare, or none"""
    k, p = F.col("event_id") % 4, F.col("props")
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), p, F.lit(" as asked."))).when(k == 2, p).otherwise("no object")
    return load(spark, sf, "events").select("event_id", F.try_variant_get(X.json_object(answer), "$.k", "bigint").alias("k"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^ \n]+'), ' ') AS abstract FROM documents""")
def restored_abstracts(spark, sf):
    """Texts back from inverted indexes of their words"""
    d = load(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \n]+"), F.lit(0)).alias("w"))
    index = d.select("doc_id", S.index_of(F.col("w")).alias("index"))
    return index.select("doc_id", S.abstract_of("index").alias("abstract"))


@query("""SELECT o_orderkey || '.' || m AS name, v AS value FROM (SELECT o_orderkey, 'o_totalprice' AS m, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::DOUBLE FROM orders UNION ALL SELECT o_orderkey, 'ratio', o_custkey / (o_orderkey % 5)::DOUBLE FROM orders WHERE o_orderkey % 5 > 0)""")
def finite_metric_rows(spark, sf):
    """Metrics as (name, value), without infinite ones and those that are no numbers"""
    k = (F.col("o_orderkey") % 5).cast("double")
    ratio = F.when(k > 0, F.col("o_custkey") / k).when(F.col("o_orderkey") % 2 == 0, float("inf")).otherwise(float("nan"))
    return S.finite_metrics(load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_totalprice", F.col("o_custkey"), ratio.alias("ratio")), "o_orderkey")


@query("""WITH s AS (SELECT l_orderkey AS paper_id, 'page-' || lpad(l_linenumber::VARCHAR, 3, '0') AS section_id, l_linenumber AS page, l_quantity::INT AS n, (l_quantity * (l_partkey % 10) / 9.0)::INT AS c, l_suppkey % 40 = 0 AS h, l_orderkey % 4 = 3 AS jats, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)
SELECT paper_id, section_id, NOT jats AND (h OR n >= 5 AND c >= 0.6 * n AND page >= greatest(1, ceil(last * 2 / 3.0))) AS is_reference FROM s""")
def reference_pages(spark, sf):
    """Pages of references by heading, share of citations and place"""
    rows = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("page-"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("section_id"), F.round("l_quantity").cast("int").alias("n_sentences"),
        F.round(F.col("l_quantity") * (F.col("l_partkey") % 10) / 9.0).cast("int").alias("n_citations"), (F.col("l_suppkey") % 40 == 0).alias("has_heading"), F.when(F.col("l_orderkey") % 4 == 3, "jats-xml/1").otherwise("pdf").alias("parser"))
    return E.reference_regions(rows).select("paper_id", "section_id", "is_reference")


_USES = [w for kind, words in TRIGGERS if kind == "USES" for w in words]


@query(f"""WITH {FOUND}, {_places("tri", _USES, 59000)}
SELECT DISTINCT h.evidence_id || ':' || h.concept || ':' || t.concept AS relation_id FROM mention h JOIN mention t ON h.evidence_id = t.evidence_id AND h.concept < t.concept JOIN tri_at g ON g.evidence_id = h.evidence_id WHERE t.char_start < g.char_start AND g.char_start < h.char_start""")
def reversed_relations(spark, sf):
    """Relations whose tail stands before a forward trigger and whose head stands behind it"""
    from lumenspan.operators import mentions as M

    spans = M.triggered(M.located(_spans(spark, sf), DICTIONARY), [("USES", tuple(_USES))]).select("evidence_id", "mentions", "triggers")
    spans = stored(spans.where("size(mentions) > 1 AND size(triggers) > 0"), "spans")  # no other sentence has a pair around a trigger; read several times
    found = spans.select("evidence_id", F.explode("mentions").alias("m")).select("evidence_id", "m.concept", "m.char_start")
    pairs = found.select("evidence_id", F.col("concept").alias("source")).distinct().join(found.select("evidence_id", F.col("concept").alias("target")).distinct(), "evidence_id").where("source < target")
    relations = pairs.select(F.concat_ws(":", F.col("evidence_id").cast("string"), "source", "target").alias("relation_id"), "source", "target", "evidence_id")
    return V.direction_faults(relations, found, spans.select("evidence_id", F.explode("triggers").alias("t")).select("evidence_id", F.col("t.char_start").alias("at")))


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def latest_events(spark, sf):
    """The newest row of each key"""
    return L.latest(load(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'name' WHEN 3 THEN 'k' ELSE '' END AS fault FROM events""")
def answers_without_fields(spark, sf):
    """The first field of an answer that its schema misses"""
    k = F.col("event_id") % 5
    body = F.when(k == 0, "{broken").when(k == 1, "[1]").when(k == 2, F.col("props")).when(k == 3, '{"name": "n", "k": true}').otherwise('{"name": "n", "k": 1.5}')
    return C.schema_faults(load(spark, sf, "events").select(F.col("event_id").alias("id"), body.alias("body")), {"name": "string", "k": "number"})


@query(r"""WITH d AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || regexp_replace(coalesce(text, ''), '\n', chr(10) || '## Part One' || chr(10)) AS t FROM documents),
l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d)),
h AS (SELECT *, CASE WHEN line = '## Part One' THEN 1 ELSE 0 END AS p FROM l), s AS (SELECT *, sum(p) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h)
SELECT doc_id AS paper_id, CASE WHEN k = 0 THEN 'title' ELSE 'part-one' END AS section_id, string_agg(CASE WHEN i = 1 THEN trim(substr(line, 3)) ELSE trim(line) END, chr(10) ORDER BY i) AS text FROM s WHERE p = 0 AND trim(line) <> '' GROUP BY 1, 2""")
def markdown_texts(spark, sf):
    """Sections of Markdown by their headings"""
    text = F.concat(F.lit("# Title "), F.col("doc_id"), F.lit("\n"), F.expr(r"""concat_ws('\n## Part One\n', slice(split(coalesce(text, ''), '\n', 2), 1, 2))"""))
    return S.markdown_sections(load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), text.alias("text"))).select("paper_id", "section_id", "text")
