"""Concept merge and acronyms against plain Python over all pairs."""

import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from lumenspan.operators import concepts as C
from lumenspan.operators import duplicates as N


def groups_of(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    out = defaultdict(list)
    for n in nodes:
        out[root(n)].append(n)
    return out


SINGULAR = {"networks": "network", "nets": "net", "analyses": "analysis"}


def keys(name):
    case = " ".join("".join(c for c in (name or "").casefold() if c.isalnum() or c in "_ -/+").split())
    sep = " ".join(case.replace("-", " ").replace("_", " ").replace("/", " ").split())
    return case, sep, " ".join(SINGULAR.get(w, w) for w in sep.split())


def judged(definitions):
    full = defaultdict(set)
    for a, f in definitions:
        if keys(a)[2]:
            full[keys(a)[2]].add(keys(f)[2])
    out = {}
    for k, names in full.items():
        kept = sorted(f for f in names if not C.fragment(f, k))
        parts = groups_of(kept, [(a, b) for a, b in combinations(kept, 2) if C.equivalence(a, b)])
        real = {f for f in names if f}
        verdict = "ambiguous" if len(parts) > 1 else "rescued" if len(kept) > 1 or len(kept) < len(names) and len(real) > 1 else "plain"
        out[k] = (len(real), len(kept), len(parts), verdict)
    return out


def merged(concepts, definitions, decides=True):
    forms = {i: {keys(x) for x in (c, *(a or ()))} for i, c, a, _ in concepts}
    verdicts = judged(definitions)
    at = defaultdict(set)
    for i, some in forms.items():
        for k in some:
            at[k[2]].add(i)
    edges, full = [], []
    for a, f in {(keys(a)[2], keys(f)[2]) for a, f in definitions}:
        found = [(i, j) for i in at.get(a, ()) if a for j in at.get(f, ()) if f and i != j]
        edges += found
        full += [(a, i, j) for i, j in found]
    basis = defaultdict(set)
    for level, name in enumerate(C.LEVELS):
        held = defaultdict(set)
        for i, some in forms.items():
            for k in some:
                if k[level]:
                    held[k[level]].add(i)
        for some in held.values():
            for i, j in combinations(sorted(some), 2):
                edges.append((i, j))
                basis[i].add(name)
    by_id = {i: (c or "", t or "") for i, c, _, t in concepts}
    out = {}
    for root, some in groups_of(sorted(by_id), edges).items():
        mine = [(a, j) for a, i, j in full if i in some]
        types = sorted({by_id[i][1] for i in some} - {""})
        why = (["definition_pair"] if mine else []) + [n for n in C.LEVELS if any(n in basis[i] for i in some)]
        verdict = "single" if len(some) == 1 else "ambiguous" if any(verdicts[a][3] == "ambiguous" for a, _ in mine) else "type_conflict" if len(types) > 1 and not (mine and decides) else "merged"
        first = lambda ids: min(ids, key=lambda i: (-len(by_id[i][0]), i))
        best = first(some)
        kind = (by_id[first([j for _, j in mine])][1] if mine and decides else "") or by_id[best][1] or (types[0] if types else "")
        for i in some:
            out[i] = (i, root, by_id[best][0], kind, verdict, len(types) > 1, why) if verdict == "merged" else (i, i, *by_id[i], verdict, False, why)
    return sorted(out.values())


WORDS = ["graph", "neural", "network", "networks", "net", "deep", "Model", "tracing", "knowledge", "knowlege", "the", "using", "a"]


def name(rng, most=4):
    return rng.choice([" ", "-", "_"]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, most)))


def test_acronyms_equal_all_pairs(spark):
    rng = random.Random(5)
    definitions = [(rng.choice(["GN", "gn", "DKT", "KT", "X", "net", ""]), rng.choice([name(rng, 6), "", "microscopy scan", "microsopy scan", "k", "kt of the kt", None])) for _ in range(150)]
    df = spark.createDataFrame(definitions, "acronym string, full_name string").withColumn("k", F.lit(1))
    got = {r["k"]: (r["n_names"], r["n_kept"], r["n_components"], r["verdict"]) for r in C.definitions_judged(df).collect()}
    assert got == judged(definitions)
    assert C.definitions_judged(df.limit(0)).count() == 0


def test_blocks_lose_no_equivalent_pair(spark):
    """Typing errors, words in common and names inside names, among some hundred names of one acronym."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstu   "
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))).strip() or "q" for _ in range(120)]
    for text in list(base):
        cut = rng.randrange(len(text) + 1)
        base += [text[:cut] + rng.choice(letters) + text[cut:], text[:cut] + text[cut + 1 :], text + " more", text[cut:]]
    names = sorted({" ".join(t.split()) for t in base} - {""})
    want = {(a, b) for a, b in combinations(names, 2) if C.equivalence(a, b)}
    got = {(r["a"], r["b"]) for r in C.candidate_pairs(spark.createDataFrame([("x", n) for n in names], "k string, f string")).collect()}
    assert want <= got and len(want) > 400
    assert len(got) < len(names) * (len(names) - 1) / 8


def test_merge_equals_all_pairs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        concepts = [(k, rng.choice([name(rng), name(rng, 2), "GN", "DKT", "", None]), rng.choice([None, [], [name(rng)], [name(rng), "KT"]]), rng.choice(["METHOD", "TASK", "", None])) for k in range(60)]
        definitions = [(rng.choice(["GN", "DKT", "KT", "graph"]), name(rng)) for _ in range(12)]
        df = spark.createDataFrame(concepts, "concept_id long, canonical string, aliases array<string>, type string").withColumn("component", F.lit("x"))
        found = spark.createDataFrame(definitions, "acronym string, full_name string")
        for decides in (True, False):
            got = sorted((r["concept_id"], r["group_id"], r["canonical"], r["type"], r["verdict"], r["type_resolved"], r["basis"]) for r in C.merged(df, found, decides).collect())
            assert got == merged(concepts, definitions, decides)
    assert C.merged(df.limit(0), found).count() == 0
    assert {r["verdict"] for r in C.merged(df, found.limit(0)).collect()} <= {"single", "merged", "type_conflict"}


def test_fragments():
    want = {"": "empty", "pca of pca": "acronym_repeated", "graph net graph net": "repeated_phrase", "the graph": "leading_function_word", "using graph": "leading_participle", "scanning electron": ""}
    assert {f: C.fragment(f, "pca") for f in want} == want


def test_cluster_reports(spark):
    rows = [("e1", 1, "a b c d e f"), ("e2", 2, "a b c d e f"), ("e3", 2, "a b c d e f"), ("e4", 3, "k l"), ("e5", 4, "m n o p q r s"), ("e6", 4, "m n o p q r s t"), ("e7", 5, "z")]
    spans = spark.createDataFrame(rows, "evidence_id string, paper_id long, text string").select("evidence_id", "paper_id", F.split("text", " ").alias("tokens"))
    pairs = spark.createDataFrame([("e5", "e6", 0.75, "near_duplicate"), ("e1", "e5", 0.65, "near_duplicate"), ("e4", "e5", 0.4, "paraphrase")], "left_id string, right_id string, similarity double, verdict string")
    got = [tuple(r) for r in N.cluster_reports(spans, pairs, N.clusters(spans, pairs)).collect()]
    assert got == [("dup:e1", 5, 3, "e1", "e2", 1.0, 0.65, 3)]
    alone = pairs.where("left_id = 'e5'")
    assert sorted(tuple(r) for r in N.cluster_reports(spans, alone, N.clusters(spans, alone)).collect()) == [("dup:e1", 3, 2, "e1", "e2", 1.0, 1.0, 1), ("dup:e5", 2, 1, "e5", "e6", 0.75, 0.75, 1)]
