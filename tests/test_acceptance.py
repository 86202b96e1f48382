"""The acceptance policy, evidence quality, located names and mended rules, by hand-made cases and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.functions.text import flattened
from lumenspan.operators import acceptance as A
from lumenspan.operators import reports as R
from lumenspan.operators import rules as U


def test_names_are_placed_from_the_left(spark):
    cases = [
        ("The graph of the graph net", ["graph", "graph net", "The"], [(0, 3, "The"), (4, 9, "graph"), (13, 16, "The"), (17, 26, "graph net")]),
        ("知识图谱和图谱", ["图谱", "知识图谱"], [(0, 4, "知识图谱"), (5, 7, "图谱")]), ("abc", [], []), ("abc", ["", "  ", None], []), (None, ["a"], []), ("a+b a+bc", ["a+b"], [(0, 3, "a+b")]),
        ("fine ﬁne", ["fine"], [(0, 4, "fine"), (5, 9, "fine")]), ("scopes ope", ["ope"], [(7, 10, "ope")]), ("ab abc", ["ab", "AB"], [(0, 2, "ab")]),
    ]
    rows = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(cases)], "k long, raw string, names array<string>").withColumn("text", flattened("raw"))
    got = {r["k"]: [tuple(h) for h in r["hits"]] for r in A.placed_names(rows, "text", {"hits": "names"}).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}
    with pytest.raises(ValueError):
        A.placed_names(rows, "text", {"raw": "names"})


def test_evidence_quality(spark):
    cases = {
        "The model improves the accuracy of retrieval.": [], "Too short.": ["too_short"], "": ["too_short", "symbols"], "The model improves accuracy using": ["cut_off"], "The model improves accuracy such as": ["cut_off"],
        "12.5 33.1 | 44.2 % 18.0 = 7.7 ab": ["symbols"], "See et al. (2019) [12] (2020) [1, 2-4] now it": ["symbols", "citations"], "As Table 3 shows, the model improves accuracy": ["layout"], "这个模型显著提高了检索的准确率和召回率，效果在所有数据上都很好": [],
        "An odd protein": ["too_short", "cut_off"], None: ["too_short", "symbols"],
    }
    rows = spark.createDataFrame([(t, k) for k, t in enumerate(cases)], "t string, k long").select("k", A.quality_faults(F.col("t")).alias("f"))
    assert {r["k"]: r["f"] for r in rows.collect()} == dict(enumerate(cases.values()))


def decide(spark, rows, **how):
    kinds = "k long, span string, head string, head_type string, tail string, tail_type string, type string"
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], kinds).withColumns({"head_aliases": F.array(F.lit("GNN")), "tail_aliases": F.lit(None).cast("array<string>")})
    out = A.decided(df, {"USES": (("METHOD",), ("DATASET",)), "SUPPORTS": (("METHOD",), ())}, {"USES": ("uses", "使用"), "SUPPORTS": ("support",)}, **how)
    return [(r["status"], r["reasons"]) for r in out.orderBy("k").collect()]


def test_policy(spark):
    rows = [
        ("The graph net uses the corpus for training tests.", "graph net", "METHOD", "corpus", "DATASET", "USES"),
        ("The GNN is trained on the corpus for many days.", "graph net", "METHOD", "corpus", "DATASET", "uses"),
        ("The graph net uses the corpus and the corpus grows.", "graph net", "METHOD", "corpus", "DATASET", "USES"),
        ("The corpus that is used by the graph net supports it.", "graph net", "METHOD", "corpus", "DATASET", "SUPPORTS"),
        ("A graph net is reported by many to use the corpus.", "graph net", "TASK", "corpus", "DATASET", "USES"),
        ("The graph net uses ideas. The corpus is described elsewhere today.", "graph net", "METHOD", "corpus", "DATASET", "USES"),
        ("The graph net uses, as in Smith et al. The corpus is here and open.", "graph net", "METHOD", "corpus", "DATASET", "USES"),
        ("The graph net corpus uses many things here today.", "graph net", "METHOD", "corpus", "DATASET", "OTHER"),
        ("Nothing of interest uses anything in this span.", "graph net", "METHOD", "corpus", "DATASET", "USES"),
        ("Short graph net.", "graph net", "METHOD", "corpus", "DATASET", "USES"), (None, None, None, None, None, None),
        ("The graph net   outperforms\nthe corpus in everything.", "graph  net", "METHOD", "corpus", None, "SUPPORTS"),
    ]
    strict, loose = decide(spark, rows), decide(spark, rows, strict=False)
    assert strict[0] == ("accepted", []) and loose[0] == ("accepted", [])
    assert strict[1] == ("needs_review", ["no_trigger"]) and loose[1] == ("accepted", [])
    assert strict[2] == ("needs_review", ["not_unique"])
    assert strict[3] == ("needs_review", ["reversed", "no_trigger"]) and loose[3] == ("needs_review", ["reversed"])
    assert strict[4] == ("needs_review", ["types", "passive"])
    assert strict[5] == ("needs_review", ["other_sentence"]) and decide(spark, rows, one_sentence=False)[5] == ("accepted", [])
    assert strict[6] == ("accepted", [])
    assert strict[7] == ("needs_review", ["no_trigger"])
    assert strict[8] == ("rejected", ["head_missing", "tail_missing"])
    assert strict[9][0] == "rejected" and strict[9][1][0] == "too_short" and strict[10] == ("rejected", ["too_short", "symbols"])
    assert strict[11] == ("accepted", [])
    assert decide(spark, []) == []


def test_concept_keys_of_all_scripts(spark):
    cases = {"知识图谱": ("知识图谱",) * 3, "单细胞测序": ("单细胞测序",) * 3, "Naïve Bayes": ("naïve bayes", "naïve bayes", "naïve baye"), "(Single-Cell_Networks.)": ("single-cell_networks", "single cell networks", "single cell network"), "Ｃ++": ("c++",) * 3, "": ("",) * 3, None: ("",) * 3, "a!b": ("ab",) * 3, "Straße": ("strasse", "strasse", "strasse")}
    rows = spark.createDataFrame([(t, k) for k, t in enumerate(cases)], "t string, k long").select("k", U.concept_keys(F.col("t"), X.singular).alias("c"))
    assert {r["k"]: tuple(r["c"]) for r in rows.collect()} == dict(enumerate(cases.values()))


def test_library_search_cuts_by_tier_first(spark):
    rows = [(k, "d" if k % 2 else "e", "graph paper" if k in (3, 9) else "graph", 1 + k % 3, 2000 + k, 1.0 - k / 100, k % 4) for k in range(20)]
    df = spark.createDataFrame(rows, "paper_id long, domain string, text string, tier long, year long, relevance double, retrieval_count long")
    cut = sorted((r for r in rows if r[1] == "d"), key=lambda r: (r[3], -r[5], -r[6], -r[4]))[:4]
    want = sorted(cut, key=lambda r: (sum(t in r[2] for t in ("graph", "paper")), -r[3], r[4]), reverse=True)
    assert [r["paper_id"] for r in U.library_search(df, "graph paper", "d", 3, first=4).collect()] == [r[0] for r in want[:3]]
    general = df.withColumn("domain", F.lit("general"))
    assert {r["paper_id"] for r in U.library_search(general, "graph paper", "general", 30).collect()} == {3, 9}


def test_papers_answer_together(spark):
    papers = spark.createDataFrame([("river of words",), ("知识图谱",), (None,)], "text string")
    ask = lambda q, df=papers: U.fallback_relevant(q, df).first()["relevant"]
    assert ask("How River") and ask("知识图谱") and not ask("lake") and not ask("lake 知识图谱") and not ask("how 如何") and not ask("River", papers.limit(0))


def test_coverage_joins_the_papers_of_all_names(spark):
    rng = random.Random(8)
    points = [(k, n, f"d{k % 3}") for k in range(30) for n in rng.sample(["A", "b", "C", " d ", "e"], rng.randrange(1, 3))]
    hits = [(rng.choice([None, k, k + 100]), rng.choice(["a", "B", "c", "D", "zz", None]), rng.randrange(3)) for k in range(30) for _ in range(rng.randrange(2))]
    ids, found = {p for p, _, _ in points}, {}
    for p, name, paper in hits:
        mine = {p} if p in ids else {q for q, n, _ in points if name and n.strip().lower() == name.strip().lower()}
        for q in mine:
            found.setdefault(q, set()).add(paper)
    want = {}
    for d in ("d0", "d1", "d2"):
        mine = [found.get(k, set()) for k in {p for p, _, e in points if e == d}]
        want[d] = (len(mine), sum(map(bool, mine)), sum(len(s) > 1 for s in mine))
    got = R.coverage(spark.createDataFrame(points, "point_id long, name string, domain string"), spark.createDataFrame(hits, "point_id long, name string, paper_id long")).collect()
    assert {r["domain"]: (r["n_points"], r["n_loose"], r["n_strict"]) for r in got} == want
    two = spark.createDataFrame([(1, "x", "d"), (1, "y", "d")], "point_id long, name string, domain string")
    one = R.coverage(two, spark.createDataFrame([(None, "x", 1), (None, "y", 2)], "point_id long, name string, paper_id long")).first()
    assert (one["n_points"], one["n_strict"]) == (1, 1)


def test_pages_of_repeated_text(spark):
    pages = [("a", 1, "same text here", 1), ("a", 2, " same text here\n", 0), ("a", 3, "other words of a page", 0), ("b", 1, "", 1), ("b", 2, None, 2), ("b", 3, "bad � sign on it", 0)]
    got = {r["document_id"]: r.asDict() for r in U.page_quality(spark.createDataFrame(pages, "document_id string, page int, text string, n_images int")).collect()}
    assert (got["a"]["n_duplicate"], got["a"]["n_scanned"], got["a"]["is_scanned"], got["a"]["n_words"]) == (2, 1, False, 11)
    assert (got["b"]["n_duplicate"], got["b"]["n_empty"], got["b"]["n_scanned"], got["b"]["is_scanned"], got["b"]["n_replacement"]) == (2, 2, 2, True, 1)


def test_no_triggers(spark):
    assert spark.range(1).select(U.trigger_type(F.lit("abc"), []).alias("t")).first()["t"] == "RELATED_TO"
    assert re.search(U.trigger_pattern("based  on"), "Based\non")
