"""Concept merge over names of parts, their spellings and acronyms, beside its SQL.

Concepts are parts: type and name in one of three spellings, or their acronym (the initials of the first two words). Small parts
define the acronyms, some with a fragment of a name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import concepts as C
from lumenspan.plans.evidence_queries import PLURAL
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _key(name: str) -> str:
    """The plural key of an ASCII name in SQL."""
    return f"array_to_string(list_transform(string_split(trim(regexp_replace(lower({name}), '[-_/ ]+', ' ', 'g')), ' '), lambda w: {PLURAL}), ' ')"


FULL, INITIALS = "(p_type || ' ' || p_name)", "p_type[1] || upper(p_name[1])"
CONCEPTS = f"""c AS (SELECT p_partkey AS concept_id, CASE p_partkey % 5 WHEN 0 THEN lower({FULL}) WHEN 1 THEN replace({FULL}, ' ', '-') WHEN 2 THEN lower({FULL}) || 's' WHEN 3 THEN {FULL} || ' ' || p_size ELSE {INITIALS} END AS canonical, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 5 < 3 THEN upper(p_brand) END AS alias,
  CASE WHEN p_partkey % 5 = 4 THEN 'METHOD' WHEN ends_with(p_name, 'gear') AND p_partkey % 2 = 0 THEN 'TASK' WHEN p_partkey % 11 = 0 THEN NULL ELSE 'DATASET' END AS type FROM part),
df AS (SELECT DISTINCT {_key(INITIALS)} AS k, {_key("CASE WHEN p_size = 3 THEN 'using ' WHEN p_size = 4 THEN 'old ' ELSE '' END || " + FULL)} AS f FROM part WHERE p_size <= 4 AND p_type <> 'PROMO' AND p_partkey % 8 < 3),
kept AS (SELECT * FROM df WHERE NOT starts_with(f, 'using '))"""
JUDGED = f"""{CONCEPTS}, eq AS (SELECT a.k, a.f AS a, b.f AS b FROM kept a JOIN kept b ON a.k = b.k AND a.f <> b.f WHERE contains(a.f, b.f) OR contains(b.f, a.f) OR 2 * len(list_intersect(string_split(a.f, ' '), string_split(b.f, ' '))) >= len(list_distinct(string_split(a.f, ' ') || string_split(b.f, ' ')))),
wk(k, a, b) AS (SELECT k, a, b FROM eq UNION SELECT wk.k, wk.a, eq.b FROM wk JOIN eq ON wk.k = eq.k AND wk.b = eq.a),
cp AS (SELECT kept.k, kept.f, coalesce(min(b), kept.f) AS c FROM kept LEFT JOIN wk ON wk.k = kept.k AND wk.a = kept.f GROUP BY 1, 2),
root AS (SELECT k, count(*) AS n_kept, count(DISTINCT least(c, f)) AS n_components FROM cp GROUP BY 1),
dj AS (SELECT k, count(*) AS n_names, coalesce(any_value(n_kept), 0) AS n_kept, coalesce(any_value(n_components), 0) AS n_components, count(*) FILTER (WHERE starts_with(f, 'using ')) AS n_fragments FROM df LEFT JOIN root USING (k) GROUP BY 1),
judged AS (SELECT k, n_names, n_kept, n_components, CASE WHEN n_components > 1 THEN 'ambiguous' WHEN n_kept > 1 OR n_fragments > 0 AND n_names > 1 THEN 'rescued' ELSE 'plain' END AS verdict FROM dj)"""
MERGED = f"""{JUDGED}, form AS (SELECT DISTINCT concept_id, lower(x) AS "case", trim(regexp_replace(lower(x), '[-_/ ]+', ' ', 'g')) AS hyphen_space, {_key("x")} AS plural FROM (SELECT concept_id, canonical AS x FROM c UNION ALL SELECT concept_id, alias FROM c WHERE alias IS NOT NULL)),
ends AS (SELECT plural, min(concept_id) AS low, max(concept_id) AS high FROM form GROUP BY 1),
de AS (SELECT k, f, a.low AS kl, a.high AS kh, b.low AS fl, b.high AS fh FROM df JOIN ends a ON a.plural = k JOIN ends b ON b.plural = f WHERE NOT (a.low = a.high AND b.low = b.high AND a.low = b.low)),
lk AS (SELECT plural AS x, plural AS y FROM ends UNION SELECT k, f FROM de UNION SELECT f, k FROM de UNION SELECT p.plural, q.plural FROM form p JOIN form q USING (concept_id)),
kw(x, y) AS (SELECT x, y FROM lk UNION SELECT kw.x, lk.y FROM kw JOIN lk ON kw.y = lk.x),
kr AS (SELECT x AS plural, min(low) AS component FROM kw JOIN ends ON ends.plural = kw.y GROUP BY 1), m AS (SELECT DISTINCT concept_id, component FROM form JOIN kr USING (plural)),
wi AS (SELECT de.*, component, verdict FROM de JOIN m ON m.concept_id = kl LEFT JOIN judged USING (k)), fl AS (SELECT component, bool_or(verdict = 'ambiguous') AS amb FROM wi GROUP BY 1),
fu AS (SELECT wi.component, arg_min(c.type, (-length(c.canonical), c.concept_id)) AS t FROM wi JOIN form ON form.plural = wi.f JOIN (SELECT concept_id, canonical, coalesce(type, '') AS type FROM c) c ON c.concept_id = form.concept_id WHERE NOT (kl = kh AND kl = form.concept_id) GROUP BY 1),
g AS (SELECT component, count(*) AS n, count(DISTINCT type) AS nt, min(type) AS ft, arg_min(canonical, (-length(canonical), concept_id)) AS best, arg_min(coalesce(type, ''), (-length(canonical), concept_id)) AS bt FROM c JOIN m USING (concept_id) GROUP BY 1),
lv AS (""" + " UNION ALL ".join(f"""SELECT DISTINCT component, '{level}' AS level FROM (SELECT min(concept_id) AS concept_id FROM form GROUP BY "{level}" HAVING count(DISTINCT concept_id) > 1) JOIN m USING (concept_id)""" for level in C.LEVELS) + """),
ls AS (SELECT component, list(level) AS ls FROM lv GROUP BY 1),
v AS (SELECT g.*, amb, t, ls, CASE WHEN n = 1 THEN 'single' WHEN coalesce(amb, false) THEN 'ambiguous' WHEN nt > 1 AND amb IS NULL THEN 'type_conflict' ELSE 'merged' END AS verdict FROM g LEFT JOIN fl USING (component) LEFT JOIN fu USING (component) LEFT JOIN ls USING (component))
SELECT concept_id, CASE WHEN verdict = 'merged' THEN component ELSE concept_id END AS group_id, CASE WHEN verdict = 'merged' THEN best ELSE canonical END AS canonical,
  CASE WHEN verdict = 'merged' THEN coalesce(CASE WHEN amb IS NOT NULL THEN nullif(t, '') END, nullif(bt, ''), ft, '') ELSE coalesce(type, '') END AS type, verdict, verdict = 'merged' AND nt > 1 AS type_resolved,
  array_to_string(list_filter([CASE WHEN amb IS NOT NULL THEN 'definition_pair' END, """ + ", ".join(f"CASE WHEN list_contains(ls, '{level}') THEN '{level}' END" for level in C.LEVELS) + """], lambda x: x IS NOT NULL), ',') AS basis
FROM c JOIN m USING (concept_id) JOIN v USING (component)"""


def _parts(spark, sf):
    p, k = load(spark, sf, "part"), F.col("p_partkey")
    full, initials = F.concat_ws(" ", "p_type", "p_name"), F.concat(F.substring("p_type", 1, 1), F.upper(F.substring("p_name", 1, 1)))
    name = F.when(k % 5 == 0, F.lower(full)).when(k % 5 == 1, F.replace(full, F.lit(" "), F.lit("-"))).when(k % 5 == 2, F.concat(F.lower(full), F.lit("s"))).when(k % 5 == 3, F.concat_ws(" ", full, "p_size")).otherwise(initials)
    kind = F.when(k % 5 == 4, "METHOD").when(F.col("p_name").endswith("gear") & (k % 2 == 0), "TASK").when(k % 11 != 0, "DATASET")
    concepts = p.select(k.alias("concept_id"), name.alias("canonical"), F.when((k % 7 == 0) & (k % 5 < 3), F.array(F.upper("p_brand"))).alias("aliases"), kind.alias("type"))
    before = F.when(F.col("p_size") == 3, "using ").when(F.col("p_size") == 4, "old ").otherwise("")
    small = p.where((F.col("p_size") <= 4) & (F.col("p_type") != "PROMO") & (k % 8 < 3))
    return concepts, small.select(initials.alias("acronym"), F.concat(before, full).alias("full_name"))


@query(f"WITH RECURSIVE {JUDGED} SELECT * FROM judged")
def acronym_verdicts(spark, sf):
    """Which acronyms stand for several things, once fragments are gone and equivalent names are one"""
    return C.definitions_judged(_parts(spark, sf)[1])


@query(f"WITH RECURSIVE {MERGED}")
def concept_merge(spark, sf):
    """Concepts merged by keys and definitions, with ambiguity, conflicts of types and what links them"""
    return C.merged(*_parts(spark, sf)).withColumn("basis", F.array_join("basis", ","))
