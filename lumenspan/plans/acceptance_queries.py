"""Names located in texts, quality of evidence, and the acceptance policy over pairs of sentences, each beside its SQL.

Relations are ours: every second sentence of a document and the next are a span, heads are articles and tails conjunctions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions.text import flattened, sentences
from lumenspan.operators import acceptance as A
from lumenspan.plans.evidence_queries import SPANS, spans
from lumenspan.plans.relation_queries import _marked
from lumenspan.session import load, ship

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NAMES = ("the", "of the", "that", "de la", "la", "und")


@query(rf"""WITH m AS (SELECT doc_id, regexp_extract_all({_marked(NAMES, 58000)}, '(?s).') AS l FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS text FROM documents)),
c AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM m)
SELECT doc_id AS paper_id, CAST(i - 1 AS INTEGER) AS char_start, CAST(i - 1 + n AS INTEGER) AS char_end, name FROM c JOIN (VALUES {", ".join(f"({58000 + k}, {len(n)}, '{n}')" for k, n in enumerate(NAMES))}) v(code, n, name) ON unicode(c) = code""")
def located_names(spark, sf):
    """Names in whole texts by place, from the left, without overlaps"""
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), flattened("text").alias("text"), F.array(*map(F.lit, NAMES)).alias("names"))
    return A.placed_names(rows, "text", {"hits": "names"}).select("paper_id", F.explode("hits").alias("h")).select("paper_id", "h.*")


TAILS = ", ".join(f"'{w}'" for w in A.CUT_TAILS)
#: The citation pattern for RE2, which knows no flag inside a Java-style group.
QUALITY = rf"""q AS (SELECT *, list_filter([CASE WHEN length(t) < 20 THEN 'too_short' END,
CASE WHEN tail <> '' AND (tail IN ({TAILS}) OR len(list_filter([{TAILS}], lambda w: ends_with(rtrim(lower(t), ' '), w))) > 0) THEN 'cut_off' END,
CASE WHEN (CASE WHEN length(t) = 0 THEN 1 ELSE length(regexp_replace(t, '[\p{{L}}\s]', '', 'g')) / length(t) END) > 0.45 THEN 'symbols' END,
CASE WHEN length(t) > 0 AND (length(t) - length(regexp_replace(t, '{A.CITED}', '', 'g'))) / length(t) > 0.3 THEN 'citations' END,
CASE WHEN regexp_matches(t, '{A.LAYOUT}') THEN 'layout' END], lambda x: x IS NOT NULL) AS faults FROM (SELECT *, lower(split_part(regexp_replace(t, '[ .;:,、，。]+$', ''), ' ', -1)) AS tail FROM span))"""


@query(rf"""WITH {SPANS}, span AS (SELECT paper_id, sentence_index, regexp_replace(text, '\s+', ' ', 'g') AS t FROM spans), {QUALITY} SELECT paper_id, sentence_index::INTEGER AS sentence_index, array_to_string(faults, ',') AS faults FROM q""")
def evidence_faults(spark, sf):
    """The five checks of evidence on every sentence"""
    ship(spark)
    rows = spans(spark, sf).select("paper_id", "sentence_index", flattened("text").alias("text"))
    return rows.select("paper_id", "sentence_index", F.array_join(A.quality_faults(F.col("text")), ",").alias("faults"))


HEADS, ENDS = ("the", "die", "les"), ("and", "und", "los")
CONSTRAINTS = {"USES": (("METHOD",), ("TASK", "DATASET")), "EVALUATES_ON": (("METHOD", "TASK"), ())}
TRIGGERS = {"USES": ("with", "mit"), "EVALUATES_ON": ("in", "en")}
#: As the policy's own, in RE2's words: short forms keep their space, other sentence ends lose it.
_KEPT = "|".join(s.replace(".", r"\.") for s in A.SHORT_FORMS)
_BROKEN = rf"translate(regexp_replace(regexp_replace(t, '(?i)\b({_KEPT})\. ', '\1.' || chr(2), 'g'), '([.!?]) ([A-Z(\[]|[一-鿿])', '\1' || chr(1) || '\2', 'g'), chr(2), ' ')"


def _policy(strict: bool) -> str:
    link = "" if strict else f" OR regexp_matches(mid, '{A.LINKS}')"
    stems = " OR ".join(f"contains(lower(mid), '{s}')" for s in A.REPORT_STEMS)
    words = " OR ".join(f"type = '{k}' AND regexp_matches(lower(mid), '(^|[^a-z0-9])({'|'.join(w)})')" for k, w in TRIGGERS.items())
    hits = lambda words: rf"len(regexp_extract_all(replace(t, '_', '~'), '(?i)\b({'|'.join(words)})\b'))"
    first = lambda words: rf"strpos(regexp_replace(replace(t, '_', '~'), '(?i)\b({'|'.join(words)})\b', chr(58000) || chr(63000) || chr(63000), 'g'), chr(58000)) - 1"
    return rf"""WITH {SPANS}, span AS (SELECT paper_id, sentence_index, trim(regexp_replace(text || '. ' || nxt, '\s+', ' ', 'g')) AS t,
  CASE sentence_index % 3 WHEN 0 THEN 'USES' WHEN 1 THEN 'OTHER' ELSE 'EVALUATES_ON' END AS type, CASE WHEN paper_id % 2 = 0 THEN 'METHOD' ELSE 'TASK' END AS ht, CASE WHEN paper_id % 3 = 0 THEN 'METRIC' ELSE 'DATASET' END AS tt
  FROM (SELECT *, lead(text) OVER (PARTITION BY paper_id ORDER BY sentence_index) AS nxt FROM spans) WHERE nxt IS NOT NULL), {QUALITY},
p AS (SELECT *, {hits(HEADS)} AS n_head, {hits(ENDS)} AS n_tail, {first(HEADS)} AS h, {first(ENDS)} AS e, {_BROKEN} AS broken FROM q),
m AS (SELECT *, CASE WHEN greatest(h, e) > least(h, e) + 3 THEN substr(t, least(h, e) + 4, greatest(h, e) - least(h, e) - 3) ELSE '' END AS mid FROM p),
d AS (SELECT *, list_filter([CASE WHEN n_head > 1 OR n_tail > 1 THEN 'not_unique' END, CASE WHEN type = 'USES' AND NOT (ht = 'METHOD' AND tt IN ('TASK', 'DATASET')) OR type = 'EVALUATES_ON' AND ht NOT IN ('METHOD', 'TASK') THEN 'types' END, CASE WHEN h > e THEN 'reversed' END,
  CASE WHEN h <= e AND regexp_matches(mid, '{A.PASSIVE}') THEN 'passive' END, CASE WHEN contains(substr(broken, least(h, e) + 1, greatest(h, e) - least(h, e)), chr(1)) THEN 'other_sentence' END,
  CASE WHEN mid = '' THEN 'adjacent' END, CASE WHEN mid <> '' AND NOT ({stems} OR {words}{link}) THEN 'no_trigger' END], lambda x: x IS NOT NULL) AS doubts,
  list_filter([CASE WHEN n_head = 0 THEN 'head_missing' END, CASE WHEN n_tail = 0 THEN 'tail_missing' END], lambda x: x IS NOT NULL) AS missing FROM m)
SELECT paper_id, sentence_index::INTEGER AS sentence_index, n_head::INTEGER AS n_head, n_tail::INTEGER AS n_tail, CASE WHEN len(faults) > 0 OR len(missing) > 0 THEN 'rejected' WHEN len(doubts) > 0 THEN 'needs_review' ELSE 'accepted' END AS status,
array_to_string(CASE WHEN len(faults) > 0 THEN faults WHEN len(missing) > 0 THEN missing ELSE doubts END, ',') AS reasons FROM d"""


def _decided(spark, sf, strict: bool):
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), sentences(F.col("text")).alias("s"))
    both = F.transform("s", lambda x, i: F.struct(x.alias("text"), F.get("s", i + 1).alias("next")))  # a document's sentences are in its row
    rows = rows.select("paper_id", F.posexplode(both).alias("sentence_index", "b")).select("paper_id", "sentence_index", "b.*").where("next IS NOT NULL")
    more = lambda words: F.array(*map(F.lit, words[1:]))
    k = F.col("sentence_index") % 3
    rows = rows.select(
        "paper_id", "sentence_index", F.concat("text", F.lit(". "), "next").alias("span"), F.when(k == 0, "USES").when(k == 1, "OTHER").otherwise("EVALUATES_ON").alias("type"),
        F.lit(HEADS[0]).alias("head"), more(HEADS).alias("head_aliases"), F.when(F.col("paper_id") % 2 == 0, "METHOD").otherwise("TASK").alias("head_type"),
        F.lit(ENDS[0]).alias("tail"), more(ENDS).alias("tail_aliases"), F.when(F.col("paper_id") % 3 == 0, "METRIC").otherwise("DATASET").alias("tail_type"),
    )
    return A.decided(rows, CONSTRAINTS, TRIGGERS, strict).select("paper_id", "sentence_index", "n_head", "n_tail", "status", F.array_join("reasons", ",").alias("reasons"))


@query(_policy(True))
def policy_strict(spark, sf):
    """The four checks of a relation, with triggers of its type"""
    return _decided(spark, sf, True)


@query(_policy(False))
def policy_loose(spark, sf):
    """The four checks of a relation, where linking words count as well"""
    return _decided(spark, sf, False)


@query()
def unwrapped_pages(spark, sf):
    """Documents whose lines were wrapped after some 40 characters, often inside words, unwrapped (tests hold it against plain Python)"""
    from lumenspan.operators import pages as P

    wrapped = F.regexp_replace(F.regexp_replace("text", r"(.{28}[a-z]{2,6})([a-z]{2,6}\b)", "$1-\n$2"), r"(.{38}) ", "$1\n")
    rows = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("document_id"), F.col("doc_id").alias("page"), wrapped.alias("text"))
    return P.unwrapped(rows)
