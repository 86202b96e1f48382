"""Mentions, triggered pairs and typed relations over all sentences of the documents, and graph searches, each beside its SQL.

The dictionary and the triggers are ours: common words of the corpus's four languages, some inside others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import extraction as E
from lumenspan.operators import graph as G
from lumenspan.operators import mentions as M
from lumenspan.plans.evidence_queries import SPANS, spans
from lumenspan.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DICTIONARY = (
    ("the", "article", "TASK"), ("die", "article", "TASK"), ("les", "article", "TASK"), ("los", "article", "TASK"), ("and", "link", "METHOD"), ("und", "link", "METHOD"),
    ("of the", "owner", "DATASET"), ("and the", "link article", "METHOD"), ("to be", "state", "METRIC"), ("be", "being", "METRIC"), ("de", "from", "DATASET"), ("que", "clause", "METRIC"), ("that", "clause", "METRIC"),
)
TRIGGERS = (("USES", ("with", "mit", "pour", "para")), ("EVALUATES_ON", ("in", "en", "den")), ("SUPPORTS", ("is", "est")))
CONSTRAINTS = {"USES": (("METHOD",), ("TASK", "DATASET")), "EVALUATES_ON": (("METHOD", "TASK"), ("DATASET", "METRIC"))}


def _marked(words, base: int) -> str:
    """Text with each word's place as a sign of its own, longest first: what is marked can't be found again."""
    out = "translate(text, '_', '~')"
    for at, word in sorted(enumerate(words), key=lambda w: (-len(w[1]), w[1])):
        out = rf"regexp_replace({out}, '(?i)\b{word}\b', chr({base + at}) || repeat(chr(63000), {len(word) - 1}), 'g')"
    return out


def _places(name: str, words, base: int) -> str:
    return rf"""{name}_m AS (SELECT paper_id * 1000000 + sentence_index AS evidence_id, paper_id, regexp_extract_all({_marked(words, base)}, '(?s).') AS l FROM spans),
{name}_at AS (SELECT evidence_id, paper_id, i - 1 AS char_start, unicode(c) - {base} AS k FROM (SELECT evidence_id, paper_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM {name}_m) WHERE unicode(c) BETWEEN {base} AND {base + len(words) - 1})"""


_ENTRIES = ", ".join(f"({k}, {len(a)}, '{c}', '{t}')" for k, (a, c, t) in enumerate(DICTIONARY))
_WORDS = [(kind, word) for kind, words in TRIGGERS for word in words]
_TRIGGERS = ", ".join(f"({k}, {len(w)}, '{t}')" for k, (t, w) in enumerate(_WORDS))
FOUND = f"""{SPANS}, {_places("men", [a for a, _, _ in DICTIONARY], 58000)},
mention AS (SELECT evidence_id, paper_id, concept, type, char_start, char_start + n AS char_end FROM men_at JOIN (VALUES {_ENTRIES}) e(k, n, concept, type) USING (k))"""
PAIRS = f"""{FOUND}, {_places("tri", [w for _, w in _WORDS], 59000)},
trig AS (SELECT evidence_id, type, k, char_start, char_start + n AS char_end FROM tri_at JOIN (VALUES {_TRIGGERS}) t(k, n, type) USING (k)),
once AS (SELECT * FROM mention QUALIFY row_number() OVER (PARTITION BY evidence_id, concept ORDER BY char_start) = 1),
pair AS (SELECT a.evidence_id, a.concept AS source, a.type AS source_type, b.concept AS target, b.type AS target_type, arg_min(t.type, (t.char_start, t.char_end, t.k)) AS type
  FROM once a JOIN once b ON a.evidence_id = b.evidence_id AND a.char_start < b.char_start JOIN trig t ON t.evidence_id = a.evidence_id
    AND (a.char_end <= t.char_start AND t.char_end <= b.char_start OR t.char_end <= a.char_start AND a.char_start - t.char_end <= 40 OR b.char_end <= t.char_start AND t.char_start - b.char_end <= 40) GROUP BY ALL)"""


def _fits(a: str, b: str) -> str:
    inside = lambda some: "(" + ", ".join(f"'{x}'" for x in some) + ")"
    return "(" + " OR ".join(f"type = '{kind}' AND {a} IN {inside(s)} AND {b} IN {inside(t)}" for kind, (s, t) in CONSTRAINTS.items()) + ")"


ORIENTED = f"""{PAIRS}, turned AS (SELECT *, {_fits("target_type", "source_type")} AND NOT {_fits("source_type", "target_type")} AS swap FROM pair),
oriented AS (SELECT evidence_id, type, CASE WHEN swap THEN target ELSE source END AS source, CASE WHEN swap THEN source ELSE target END AS target,
  CASE WHEN swap THEN target_type ELSE source_type END AS source_type, CASE WHEN swap THEN source_type ELSE target_type END AS target_type FROM turned)"""


def _spans(spark, sf):
    return spans(spark, sf).select((F.col("paper_id") * 1000000 + F.col("sentence_index")).alias("evidence_id"), "paper_id", "text")


def _pairs(spark, sf):
    return M.pairs(M.triggered(M.located(_spans(spark, sf), DICTIONARY), list(TRIGGERS)), M.ADJACENT, "evidence_id")


@query(f"""WITH {FOUND} SELECT 'mention:' || substr(sha1(evidence_id || chr(31) || concept || chr(31) || char_start || chr(31) || char_end), 1, 14) AS mention_id, evidence_id, paper_id, concept, type,
CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM mention""")
def dictionary_mentions(spark, sf):
    """Greedy mentions, longest aliases first, by an automaton"""
    return E.mentions(_spans(spark, sf), DICTIONARY)


@query(f"WITH {PAIRS} SELECT evidence_id, source, target, type FROM pair")
def triggered_pairs(spark, sf):
    """Pairs of mentions that a trigger lies between or beside"""
    return _pairs(spark, sf).select("evidence_id", "source", "target", "type")


@query(f"WITH {ORIENTED} SELECT source, target, type, source_type, target_type, count(DISTINCT evidence_id) AS n_evidence, round(least(0.96, 0.78 + 0.03 * count(DISTINCT evidence_id) * (count(DISTINCT evidence_id) - 1) / 2), 6)::DOUBLE AS confidence FROM oriented GROUP BY ALL")
def oriented_relations(spark, sf):
    """Triggered pairs turned round by the constraints of their type, and their evidence"""
    return M.relations(M.oriented(_pairs(spark, sf), CONSTRAINTS))


# Graph searches: brands and names of parts, joined by the parts' kinds; a name's community is its noun, a brand's its first digit.
SEEDS = ("small plate", "Brand#33", "nowhere", "Brand#12")
WORDS = ("small", "plate", "anvil", "33")
GRAPH = """e AS (SELECT p_brand AS a, p_name AS b, CASE WHEN p_size % 2 = 0 THEN 'USES' ELSE 'EXTENDS' END AS type, max(p_retailprice / 10000) AS c, min(p_size) AS size FROM part GROUP BY ALL),
u AS (SELECT a, b, type, c, size FROM e UNION ALL SELECT b, a, type, c, size FROM e), s AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {k})" for k, n in enumerate(SEEDS, 1)) + """) v(node, place))"""


def _graph(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, "USES").otherwise("EXTENDS")
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("src"), F.col("p_name").alias("dst"), kind.alias("type")).agg(F.max(F.col("p_retailprice") / 10000).alias("confidence"), F.min("p_size").alias("size"))


def _seeds(spark):
    return spark.createDataFrame(list(enumerate(SEEDS, 1)), "place int, node string")


def _members(spark, sf):
    part = load(spark, sf, "part")
    return part.select(F.col("p_brand").alias("node"), F.substring("p_brand", 7, 1).alias("community")).unionByName(part.select(F.col("p_name").alias("node"), F.element_at(F.split("p_name", " "), -1).alias("community")))


@query(f"""WITH {GRAPH}, nb AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY best.c DESC, best.type DESC, b) AS r FROM (SELECT a, b, max({{'c': c, 'type': type}}) AS best FROM u WHERE size <= 4 GROUP BY 1, 2)),
d0 AS (SELECT node, [place] AS way FROM s), d1 AS (SELECT b AS node, min(list_append(way, r)) AS way FROM d0 JOIN nb ON a = node WHERE b NOT IN (SELECT node FROM d0) GROUP BY 1),
d2 AS (SELECT b AS node, min(list_append(way, r)) AS way FROM d1 JOIN nb ON a = node WHERE b NOT IN (SELECT node FROM d0) AND b NOT IN (SELECT node FROM d1) GROUP BY 1),
al AS (SELECT node, 0 AS depth, way FROM d0 UNION ALL SELECT node, 1, way FROM d1 UNION ALL SELECT node, 2, way FROM d2)
SELECT node, depth, row_number() OVER (ORDER BY depth, way)::INTEGER AS place FROM al ORDER BY depth, way LIMIT 18""")
def bfs_capped(spark, sf):
    """The first 18 nodes that a queue visits from four seeds in their order, at most two steps away"""
    return G.reach(_graph(spark, sf).where("size <= 4"), _seeds(spark), depth=2, cap=18)


PRIMERS = f"""{GRAPH}, m AS (SELECT p_brand AS node, substr(p_brand, 7, 1) AS community FROM part UNION SELECT p_name, split_part(p_name, ' ', -1) FROM part),
near AS (SELECT community, count(s.node) AS n, count(*) AS size FROM m LEFT JOIN s ON s.node = m.node GROUP BY 1 HAVING count(s.node) > 0),
top AS (SELECT community, row_number() OVER (ORDER BY n DESC, round(n / size, 3) DESC, community) AS k FROM near QUALIFY k <= 2),
deg AS (SELECT a AS node, count(*) AS d FROM u GROUP BY 1), ranked AS (SELECT m.node, k, row_number() OVER (PARTITION BY k ORDER BY coalesce(d, 0) DESC, m.node) AS r FROM m JOIN top USING (community) LEFT JOIN deg ON deg.node = m.node QUALIFY r <= 3),
way AS (SELECT node, min(w) AS w FROM (SELECT node, [0, place] AS w FROM s UNION ALL SELECT node, [k, r] FROM ranked) GROUP BY 1),
primer AS (SELECT node, row_number() OVER (ORDER BY w)::INTEGER AS place FROM way ORDER BY w LIMIT 6)"""


@query(f"WITH {PRIMERS} SELECT node, place FROM primer")
def hybrid_primers(spark, sf):
    """Seeds and the best members of their communities"""
    return G.primers(_graph(spark, sf), _seeds(spark), _members(spark, sf))


@query(f"""WITH {PRIMERS}, p1 AS (SELECT [a, b] AS path, max(c) AS t FROM u JOIN primer ON a = primer.node GROUP BY 1), p2 AS (SELECT list_append(path, b) AS path, max(t + c) AS t FROM p1 JOIN u ON u.a = path[-1] WHERE NOT list_contains(path, b) GROUP BY 1),
al AS (SELECT *, len(path) - 1 AS n_edges, len(list_intersect(regexp_extract_all(lower(array_to_string(path, ' ')), '[a-z0-9]+'), [{", ".join(repr(w) for w in WORDS)}])) AS shared FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)),
r AS (SELECT path, n_edges, round(t + 0.15 * n_edges + 0.2 * shared, 6) AS score FROM al ORDER BY 2 DESC, 3 DESC, 1 LIMIT 6)
SELECT array_to_string(path, ' > ') AS path, n_edges, score FROM r""")
def hybrid_paths(spark, sf):
    """Paths of two steps from the primers, scored with the words of a query"""
    return G.hybrid(_graph(spark, sf), _seeds(spark), _members(spark, sf), WORDS).withColumn("path", F.array_join("path", " > "))
