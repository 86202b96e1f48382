"""Summaries and mappers on small cases: nulls, empty tables, ties."""

import json

from lumenspan.operators import summaries as S


def test_variant_report(spark):
    decisions = spark.createDataFrame([("v", 1, "accepted", True), ("v", 2, "accepted", False), ("v", 3, "needs_review", True), ("v", 4, None, None), ("w", 1, "rejected", True)], "variant string, claim_id long, status string, gold boolean")
    evidence = spark.createDataFrame([(1, "p1", True), (1, "p2", True), (2, "p1", None), (3, "p1", True)], "claim_id long, paper_id string, valid boolean")
    got = {r["variant"]: r for r in S.variant_report(decisions, evidence).collect()}
    v, w = got["v"], got["w"]
    assert (v["tp"], v["fp"], v["fn"], v["n_supported"], v["n_unsupported"], v["n_complete"], v["n_papers"]) == (1, 1, 1, 2, 2, 1, 2)
    assert (v["precision"], v["recall"], v["unsupported_rate"], v["coverage"], v["yield_per_paper"], v["f1"]) == (0.5, 0.5, 0.5, 0.5, 0.5, 0.5)
    assert (w["precision"], w["precision_low"], w["precision_high"], w["yield_per_paper"], w["n_rejected"]) == (0.0, 0.0, 0.0, 0.0, 1)
    assert S.variant_report(decisions.limit(0), evidence).count() == 0


def test_frequency(spark):
    df = spark.createDataFrame([("a", 5, 3, 2), ("b", 0, 0, 0), ("c", 2, 2, 0)], "concept string, raw_df long, independent_df long, duplicate_df long")
    assert tuple(S.frequency_report(df).first()) == (3, 2, 1, 7, 5, 2, 0.285714)
    assert tuple(S.frequency_report(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0.0)
    assert {tuple(r) for r in S.drop_distribution(df).collect()} == {(2, 1), (0, 2)}


def test_communities(spark):
    members = spark.createDataFrame([(k, k % 3) for k in range(10)] + [(0, 0), (None, 5)], "node long, community long")
    chosen = spark.createDataFrame([(1,), (4,), (2,), (2,), (None,)], "node long")
    assert [tuple(r) for r in S.matched_communities(members, chosen, 5).collect()] == [(1, 3, 2, 0.667), (2, 3, 1, 0.333)]
    assert [tuple(r) for r in S.largest_communities(members, 2).collect()] == [(0, 4), (1, 3)]


def test_proxies_panels_and_atlas(spark):
    runs = spark.createDataFrame([("r", 9, 1, ["Graph", "x"], ["Knowledge GRAPH"]), ("s", 2, 1, None, None), ("t", 1, 1, [], [])], "run_id string, target int, expected int, required array<string>, covered array<string>")
    claims = spark.createDataFrame([("r", "accepted", 0), ("r", "accepted", 2), ("r", "rejected", None), ("s", None, 1)], "run_id string, status string, n_evidence int")
    got = {r["run_id"]: tuple(r)[1:] for r in S.run_proxies(runs, claims).collect()}
    assert got == {"r": (50.0, 0.0, 50.0, 2, 1), "s": (100.0, 80.0, 100.0, 0, 0), "t": (100.0, 100.0, 100.0, 0, 0)}
    queues = spark.createDataFrame([("p", 5), ("q", 0)], "panel_id string, n_available long")
    verdicts = spark.createDataFrame([("p", "accepted"), ("p", None), ("q", "rejected")], "panel_id string, status string")
    assert {tuple(r) for r in S.panel_counts(queues, verdicts).collect()} == {("p", 2, 1, 0, 0, 3), ("q", 1, 0, 0, 1, 0)}
    papers = spark.createDataFrame([("d", True), ("d", None), (None, True)], "domain string, metadata_only boolean")
    none = spark.createDataFrame([], "domain string, entity_id string, relation_id string")
    assert [tuple(r) for r in S.atlas(papers, none, none).collect()] == [("d", 2, 1, 1, 0, 0)]


def test_records(spark):
    records = [{"DOI": "10.1/AB", "title": [], "abstract": "<b>x</b> &lt; y", "author": [{"given": " Ann ", "family": "Lee"}, {}]}, {"DOI": "10.1/ab", "title": ["z"]}, {"title": ["no id"]}, {"DOI": "10.1/c", "title": ["T"], "published": {"date-parts": [[2020, 3]]}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("broken",), (None,)], "value string")
    got = {r["paper_id"]: r for r in S.crossref_papers(df).collect()}
    assert set(got) == {"doi:10.1/ab", "doi:10.1/c"}
    first, second = got["doi:10.1/ab"], got["doi:10.1/c"]
    assert (first["title"], first["summary"], first["authors"], first["year"], first["source_url"]) == ("10.1/ab", "x < y", ["Ann Lee", ""], 0, "https://doi.org/10.1/ab")
    assert (second["year"], second["published"], second["summary"], second["publisher"]) == (2020, "2020-3", "T", "Crossref member")
    papers = spark.createDataFrame([(json.dumps({"paperId": "p", "title": "T", "authors": [{"name": None}, {"name": "A"}], "externalIds": {"DOI": "10.1/X"}}),), ('{"title": "none"}',), ("[",)], "value string")
    rows = S.scholar_papers(papers).collect()
    assert [(r["paper_id"], r["summary"], r["authors"], r["doi"], r["license"]) for r in rows] == [("s2:p", "T", ["A"], "10.1/x", "metadata-only")]


def test_federation(spark):
    from lumenspan.operators import federation as N

    paper = lambda i, title, tier, doi="", concepts=None, summary=None: (i, title, summary, concepts, doi, "", tier, 2020)
    a = spark.createDataFrame([paper("a1", "Graph models", 2, "10.1/X"), paper("a2", "Nothing", 1), paper("a3", "graph", 2, concepts=["model", "x"]), paper("a4", None, 3)], N.PAPER)
    b = spark.createDataFrame([paper("b1", "Graph model of all", 1, "10.1/x"), paper("b2", "the design system for", 2)], N.PAPER)
    papers, report = N.search(spark, {"a": a, "b": b, "c": None}, ["the graph", "Model design"], 5)
    assert [(r["paper_id"], r["official"], r["score"]) for r in papers.collect()] == [("b1", 1, 12.0), ("a2", 1, 6.0), ("a3", 0, 8.0)]
    assert sorted(tuple(r) for r in report.collect()) == [("a", True, 4), ("b", True, 2), ("c", False, 0)]
    papers, report = N.search(spark, {"c": None}, ["x"], 5)
    assert papers.count() == 0 and [tuple(r) for r in report.collect()] == [("c", False, 0)]
