"""How machine-made the documents sound, and their rewrites, each beside its SQL.

Documents whose id is divisible by 3 begin with a sentence or two of ours, since invented prose holds no clichés.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import signals as G
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LEADS = (
    "值得注意的是，这不仅是重要的创新更是关键的一步。随着技术的不断发展，我们应该让我们一起展望未来！因此所以于是有进展。", "In conclusion, it is worth noting that this robust landscape plays a crucial role. Furthermore, moreover, it is good, great, excellent and positive!\n1. One\n2、Two\n3) Three\n",
    "Therefore it may, might, possibly and potentially fail. Obviously the significant, successful and effective Great Model of 2020 is 3.5% good？Hence thus.", "综上所述，首先我们讨论了整个系统的总体结构和全部设计细节，其次我们讨论了各个模块之间的相互关系与依赖，最后我们给出了显著而且明显的结论，并且大幅提升了所有方面，意义重大。\n众所周知，价值明显。",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LEAD = "CASE doc_id % 12 " + " ".join(f"WHEN {3 * k} THEN {_quoted(t)}" for k, t in enumerate(LEADS)) + " ELSE '' END"
DOCS = f"d AS (SELECT doc_id, {_LEAD} || coalesce(CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 120) END, '') AS t FROM documents)"


def _docs(spark, sf):
    lead = F.lit("")
    for k, text in enumerate(LEADS):
        lead = F.when(F.col("doc_id") % 12 == 3 * k, text).otherwise(lead)
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 120))
    return load(spark, sf, "documents").select("doc_id", F.concat(lead, F.coalesce(body, F.lit(""))).alias("text"))


_list = lambda words: "[" + ", ".join(_quoted(w) for w in words) + "]"
_some = lambda text, words: f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"
_match = lambda text, patterns: "(" + " + ".join(f"regexp_matches({text}, {_quoted(p)})::INT" for p in patterns) + ")"
_times = lambda text, words: f"list_sum(list_transform({_list(words)}, lambda w: (length({text}) - length(replace({text}, w, ''))) / length(w)))"
_if = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
SCORED = rf"""{DOCS}, s AS (SELECT *, lower(t) AS low, list_filter(list_transform(regexp_split_to_array(t, '[。！？!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM d),
n AS (SELECT *, len(s) AS n, CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: {_some("lower(x)", G.CLICHES)} + {_match("x", G.CLICHE_PATTERNS)} > 0)) / len(s) ELSE 0 END AS templated, list_transform(p, lambda x: length(x)) AS sizes FROM s),
l AS (SELECT doc_id, t, {_if(f"n > 3 AND len(list_filter(s, lambda x: {_some('x', G.JUDGING)} > 0)) / n < 0.2", 40)} + {_if(f"n > 0 AND regexp_matches(t, '{G.PRAISE}') AND NOT regexp_matches(t, '{G.FACTS}')", 20)} AS opinion,
 {_if("len(p) >= 3 AND list_stddev_pop(sizes) / list_avg(sizes) < 0.2", 30)} + {_if(f"len(list_filter(p, lambda x: regexp_matches(x, '{G.MECHANICAL}'))) >= 3", 25)} + {_if(f"regexp_matches(t, '{G.THREE_STEPS}')", 20)} AS structure,
 least(100, 8 * ({_some("low", G.CLICHES)} + {_match("t", G.CLICHE_PATTERNS)}) + 5 * {_some("low", G.EMPTY_WORDS)} + {_if(f"n > 0 AND {_times('low', G.CONNECTORS)} / n > 0.3", 20)} + {_if("n >= 2 AND templated >= 0.5", 35)} + {_if("n >= 2 AND templated >= 0.25 AND templated < 0.5", 15)} + {_if(_match("t", G.SUBLIMATION) + " > 0", 15)}) AS expression,
 {_if(f"length(t) > 200 AND len(regexp_extract_all(t, '{G.NUMBER}')) < 2 AND len(regexp_extract_all(t, '{G.PROPER}')) < 3", 35)} + {_if(f"len(regexp_extract_all(t, '{G.HEDGE}')) > 3", 15)} AS material,
 {_if(f"n > 0 AND {_times('low', G.SMOOTH)} / n > 0.2", 25)} + {_if(f"regexp_matches(low, '{G.KNOWING}')", 20)} AS narrative,
 {_if(f"regexp_matches(low, '{G.UPLIFT}')", 30)} + {_if(f"{_times('low', G.FLAT)} > 3 AND len(regexp_extract_all(low, '{G.TROUBLE}')) = 0", 20)} AS emotion FROM n),
z AS (SELECT *, round_even((15 * opinion + 25 * structure + 30 * expression + 10 * (material + narrative + emotion)) / 100.0, 0)::INTEGER AS score FROM l)"""


@query(f"WITH {SCORED} SELECT doc_id, opinion, structure, expression, material, narrative, emotion, score, CASE WHEN score < 25 THEN 'human' WHEN score < 55 THEN 'mild_ai' ELSE 'heavy_ai' END AS verdict FROM z")
def human_signal(spark, sf):
    """Six layers, their weighted score and the verdict"""
    return G.scored(_docs(spark, sf)).select("doc_id", "signal.*")


_LIGHT = "t"
for _old, _new in G.REPLACED:
    _LIGHT = f"replace({_LIGHT}, {_quoted(_old)}, {_quoted(_new)})"
_LIGHT = rf"regexp_replace(regexp_replace({_LIGHT}, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_SENTENCES = lambda c: rf"list_filter(list_transform(regexp_split_to_array({c}, '[。！？!?\n]+'), lambda x: trim(x)), lambda x: x <> '')"
_LOFTY = "x"
for _pattern in G.SUBLIMATION:
    _LOFTY = f"regexp_replace({_LOFTY}, '{_pattern}', '', 'g')"


@query(rf"""WITH {DOCS}, a AS (SELECT doc_id, t, {_LIGHT} AS light FROM d),
b AS (SELECT *, array_to_string(list_transform(string_split(light, chr(10)), lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[0-9]+[.、]') THEN regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^([0-9]+)[.、]\s*', '\1. ') ELSE x END), chr(10)) AS listed FROM a),
m AS (SELECT *, coalesce(array_to_string(list_transform({_SENTENCES("listed")}, lambda x: CASE WHEN regexp_matches(x, '{G.VAGUE}') AND NOT regexp_matches(x, '{G.FIGURES}') THEN regexp_replace(x, '[。.]+$', '') || '{G.ASK_FOR_DATA}' ELSE x END), ''), '') AS medium FROM b),
c AS (SELECT *, coalesce(array_to_string(list_transform({_SENTENCES("medium")}, lambda x: CASE WHEN length(x) > 60 AND len(string_split(x, '，')) > 2 THEN array_to_string(string_split(x, '，')[1:2], '，') || '。' || array_to_string(string_split(x, '，')[3:], '，') ELSE x END), ''), '') AS x FROM m),
h AS (SELECT *, {_LOFTY} AS heavy FROM c)
SELECT doc_id, md5(regexp_replace(light, '^\s+|\s+$', '', 'g')) AS light, md5(regexp_replace(medium, '^\s+|\s+$', '', 'g')) AS medium, md5(regexp_replace(heavy, '^\s+|\s+$', '', 'g')) AS heavy FROM h WHERE regexp_matches(t, '\S')""")
def rewritten_texts(spark, sf):
    """The three strengths of rewriting (their digests)"""
    rows = _docs(spark, sf).where(F.col("text").rlike(r"\S"))
    return rows.select("doc_id", *(F.md5(G.rewritten(F.col("text"), s).cast("binary")).alias(s) for s in ("light", "medium", "heavy")))


@query(f"WITH {SCORED} SELECT doc_id % 12 AS grp, count(*) AS n, count(*) FILTER (WHERE score < 30) AS n_pass FROM z GROUP BY 1")
def quality_gate(spark, sf):
    """Texts that may go out"""
    return G.gated(_docs(spark, sf)).groupBy((F.col("doc_id") % 12).alias("grp")).agg(F.count("*").alias("n"), F.count_if("passes").alias("n_pass"))
