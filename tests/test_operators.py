"""Operators against plain Python and hand-made expectations."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspan.functions import metrics as M
from lumenspan.functions import text as X
from lumenspan.operators import decisions as D
from lumenspan.operators import duplicates as N
from lumenspan.operators import extraction as E
from lumenspan.operators import library as L
from lumenspan.operators import reports as R
from lumenspan.operators.components import connected_components
from lumenspan.plans import evidence_queries
from lumenspan.sources import readers as S
from lumenspan.streaming import decisions as stream

EVENT = "claim_id string, seq long, arrival long, event_type string, actor string, evidence_id string, source string, replace_valid boolean, superseded_by string, override_status string"


def wilson(spark, k, n, f=M.wilson):
    low, high = f(F.lit(k), F.lit(n))
    return tuple(spark.range(1).select(low, high).first())


def test_wilson_bounds(spark):
    assert wilson(spark, 0, 73)[1] < 0.05 <= wilson(spark, 0, 72)[1]
    assert wilson(spark, 0, 0) == (0.0, 1.0)
    assert wilson(spark, 0, 0, M.wilson_ablation) == (0.0, 0.0)
    highs = [wilson(spark, 0, n)[1] for n in (10, 50, 100)]
    assert highs == sorted(highs, reverse=True)


def test_kappa(spark):
    rows = [("A", "A"), ("A", "A"), ("A", "B"), ("B", "B"), ("A", None)]
    got = R.kappa(spark.createDataFrame(rows, "label_1 string, label_2 string")).first()
    assert (got["n"], got["observed"], got["expected"], got["kappa"]) == (4, 0.75, 0.5, 0.5)
    same = R.kappa(spark.createDataFrame([("A", "A")], "label_1 string, label_2 string")).first()
    assert same["kappa"] == 1.0
    assert R.kappa(spark.createDataFrame([], "label_1 string, label_2 string")).first()["kappa"] is None


def test_hallucination(spark):
    rows = [("accepted", "UNSUPPORTED", None), ("accepted", "SUPPORTED", False), ("accepted", "INSUFFICIENT", True), ("needs_review", "UNSUPPORTED", True)]
    got = R.hallucination(spark.createDataFrame(rows, "status string, label string, error boolean")).first()
    assert (got["n_accepted"], got["n_wrong"], got["rate"], got["insufficient_ratio"], got["passes"]) == (2, 1, 0.5, 0.25, False)


def test_adaptation(spark):
    rows = [("a", 3, 4, list("abcde"), list("abcd"), ["m"], list("mnopq")), ("b", 1, 3, list("abc"), list("ab"), ["m", "n"], list("mnopq")), ("c", 2, 2, [], [], [], [])]
    df = spark.createDataFrame(rows, "path_id string, expected int, target int, required array<string>, covered array<string>, mastered array<string>, targets array<string>")
    got = {r["path_id"]: (r["gap"], r["coverage"], r["mastered_share"], r["suitable"]) for r in R.adaptation(df).collect()}
    assert got == {"a": (1, 0.8, 0.2, True), "b": (2, 0.666667, 0.4, False), "c": (0, 1.0, 0.0, True)}


def test_p95_place(spark):
    for n in (1, 2, 19, 20, 21, 99, 100):
        values = sorted(random.Random(n).random() for _ in range(n))
        want = values[min(n - 1, max(0, round(0.95 * n + 0.5) - 1))]
        df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
        assert df.groupBy("g").agg(M.p95(F.collect_list("v")).alias("p")).first()["p"] == want
        assert R.timing_large(df, "g", "v").first()["p95"] == pytest.approx(want, abs=1e-6)
        assert R.timing(df, "g", "v").first()["p95"] == pytest.approx(want, abs=1e-6)


def slow_fold(events):
    """Evidence of each claim, one event after another."""
    held = defaultdict(dict)
    for e in sorted(events, key=lambda e: e["seq"]):
        own, key, kind = held[e["claim_id"]], e["evidence_id"], e["event_type"]
        if key is None:
            continue
        if kind in ("add_support", "add_refute"):
            own[key] = (kind, e["source"])
        elif kind == "delete_evidence" or kind == "replace_span" and not e["replace_valid"]:
            own.pop(key, None)
        elif kind == "replace_span":
            own[key] = (own.get(key, ("add_support", None))[0], e["source"])
    return held


def slow_status(claim, strength, events, held):
    own = sorted((e for e in events if e["claim_id"] == claim), key=lambda e: e["seq"])
    if not own:
        return "candidate", None
    if own[-1]["event_type"] == "human_override":
        return own[-1]["override_status"], None
    after = None
    for e in own:
        if e["event_type"] == "add_superseding" and e["superseded_by"] and held.get(e["superseded_by"]):
            after = e["superseded_by"]
    if after:
        return "superseded", after
    support = [s for k, s in held[claim].values() if k == "add_support"]
    refute = [s for k, s in held[claim].values() if k == "add_refute"]
    sources = len({s for s in support if s})
    if not support and not refute:
        return "rejected", None
    if strength == "absolute" and sources < 2 or not support:
        return "rejected", None
    if refute:
        return "needs_review", None
    return ("accepted" if sources >= 2 else "needs_review"), None


def test_projection_equals_a_sequential_fold(spark):
    rng = random.Random(4)
    events = []
    for seq in range(900):
        kind = rng.choice([*D.TYPES[:4]] * 3 + ["add_superseding", "human_override"])
        plain = kind in D.TYPES[:4]
        events.append(dict(claim_id=f"c{rng.randint(0, 39)}", seq=seq, arrival=seq, event_type=kind, actor="judge", evidence_id=f"e{rng.randint(0, 3)}" if plain else None, source=rng.choice(["s1", "s2", "", None]) if plain else None,
                           replace_valid=rng.choice([True, False, None]), superseded_by=f"c{rng.randint(0, 44)}" if kind == "add_superseding" else None, override_status="accepted" if kind == "human_override" else None))
    claims = [(f"c{k}", rng.choice(["plain", "progressive", "absolute"])) for k in range(45)]
    df, cf = spark.createDataFrame(events, EVENT), spark.createDataFrame(claims, "claim_id string, strength string")
    held = slow_fold(events)
    got = {(r["claim_id"], r["evidence_id"]): (r["kind"], r["source"]) for r in D.valid_evidence(df).collect()}
    assert got == {(c, e): v for c, own in held.items() for e, v in own.items()}
    states = {r["claim_id"]: (r["status"], r["superseded_by"]) for r in D.projection(df, cf).collect()}
    assert states == {c: slow_status(c, s, events, held) for c, s in claims}
    assert D.projection(df, cf).exceptAll(D.projection(df.repartition(5), cf)).isEmpty()


def test_rejects(spark):
    rows = [("a", 1, 1, "add_support", "judge"), ("a", 1, 2, "add_support", "judge"), ("a", 5, 3, "what", "judge"), ("a", 9, 4, "add_refute", "who"), ("z", 1, 5, "add_support", "judge"), ("a", 7, 6, "add_support", "judge")]
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], EVENT)
    got = {(r["arrival"], r["reason"]) for r in D.rejects(df, spark.createDataFrame([("a", "plain")], "claim_id string, strength string")).collect()}
    assert got == {(2, "sequence"), (3, "unknown_type"), (4, "unknown_actor"), (5, "unknown_claim"), (6, "sequence")}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=8, deadline=None)
def test_components(spark, pairs):
    root = {i: i for p in pairs if p[0] != p[1] for i in p}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(pairs, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == root


def test_components_of_a_hub_and_a_chain(spark):
    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(10000, 10200).select("id", (F.col("id") + 1).alias("dst")).toDF("src", "dst")
    got = connected_components(hub.union(chain)).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, 3000), (10000, 201)}


def test_singular(spark):
    pairs = {"networks": "network", "data": "datum", "bias": "bias", "gas": "gas", "studies": "study", "boxes": "box", "classes": "class", "analysis": "analysis", "glass": "glass", "virus": "virus", "cat": "cat", "dies": "die"}
    df = spark.createDataFrame([(w,) for w in pairs], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", X.singular(F.col("w")).alias("s")).collect()} == pairs


def test_sentences():
    text = "We see 3.5 units. See Fig. 2 here! J. Smith et al. agree.\nNext line 。Wide"
    got = X.split_sentences(text)
    assert [s for _, _, s in got] == ["We see 3.5 units.", "See Fig. 2 here!", "J. Smith et al. agree.", "Next line 。", "Wide"]
    assert all(text[a:b] == s for a, b, s in got)


@given(st.text(st.sampled_from("ab. !?\n3A"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_sentence_offsets(text):
    got = X.split_sentences(text)
    assert all(text[a:b] == s and s == s.strip() and s for a, b, s in got)
    assert re.sub(r"\s", "", "".join(s for _, _, s in got)) == re.sub(r"\s", "", text)


def test_names():
    assert X.normalized_name(" Multi-Agent_System ") == "multi agent system"
    assert X.normalized_name("科研 文献") == "科研 文献"
    assert X.names_equivalent("principal component analysis", "preceding Principal-Component analysis") == "substring"
    assert X.names_equivalent("crystal graph neural network", "crystal graph deep neural network") == "word_jaccard"
    assert X.names_equivalent("microscopy", "microsopy") == "char_similarity"
    assert X.names_equivalent("apple", "quartz") == ""


def test_independent_frequency_equals_plain_python(spark, sf):
    rows, members = evidence_queries._clusters(spark, sf)
    cluster = {r["evidence_id"]: r["cluster"] for r in members.collect()}
    root = {r["paper_id"]: r["paper_id"] for r in rows.select("paper_id").distinct().collect()}
    by = defaultdict(set)
    for r in rows.select("evidence_id", "paper_id").collect():
        if r["evidence_id"] in cluster:
            by[cluster[r["evidence_id"]]].add(r["paper_id"])
    for _ in range(20):
        for papers in by.values():
            least = min(root[p] for p in papers)
            for p in papers:
                root[p] = least
    got = {r["paper_id"]: r["unit"] for r in N.independent_papers(rows.select("evidence_id", "paper_id"), members).collect()}
    assert got == root


def test_near_pairs_verdicts(spark):
    base = [f"w{k}" for k in range(20)]
    rows = [(1, base, ["X"], ["3"]), (2, base[:-2] + ["a", "b"], ["X"], ["3"]), (3, base[:13] + [f"z{k}" for k in range(7)], ["X"], ["3"]), (4, base[:14] + [f"y{k}" for k in range(6)], ["Q"], ["3"]), (5, ["lone"], [], [])]
    df = spark.createDataFrame(rows, "wording_id long, tokens array<string>, entities array<string>, numbers array<string>")
    got = {(r["left_id"], r["right_id"]): r["verdict"] for r in N.near_pairs(df).collect()}
    assert got[(1, 2)] == "near_duplicate" and got[(1, 3)] == "near_duplicate" if (9 / 23) >= 0.4 else got[(1, 3)] == "paraphrase"
    assert got[(1, 4)] == "paraphrase" and not any(5 in k for k in got)


def test_search_falls_back_as_a_whole(spark):
    papers = spark.createDataFrame([(1, "graph text", 2019), (2, "other", 2020), (3, "more", 2018)], "paper_id long, text string, year int")
    assert [r["paper_id"] for r in L.search(papers, ["graph"], 5).collect()] == [1]
    assert [(r["paper_id"], r["score"]) for r in L.search(papers.where("year <= 2020"), ["none"], 2).collect()] == [(2, 0.0), (1, 0.0)]


def test_upsert_and_insert(spark):
    held = spark.createDataFrame([(1, "long summary", 2, "cc", "a"), (2, "xx", 1, "cc", "b")], "paper_id long, summary string, tier int, license string, title string")
    new = spark.createDataFrame([(1, "short", 1, "", "A"), (2, "yy", 3, "mit", "B"), (3, "n", 2, "", "C")], held.schema)
    got = sorted(tuple(r) for r in L.upsert_papers(held, new).collect())
    assert got == [(1, "long summary", 1, "cc", "A"), (2, "yy", 1, "mit", "B"), (3, "n", 2, None, "C")]
    assert sorted(r["title"] for r in L.insert_ignore(held, new, "paper_id").collect()) == ["C", "a", "b"]


def test_markdown(spark):
    docs = spark.createDataFrame([("p", "# Title here\nintro\n## Method A\nline one\n\nline two\n## Empty\n## Method a\nmore")], "paper_id string, text string")
    got = {r["section_id"]: r["text"] for r in S.markdown_sections(docs).collect()}
    assert got == {"title": "Title here\nintro", "method-a": "line one\nline two\nmore"}


JATS = "<article xmlns='urn:j'><front/><body><p>Before it.</p><sec><title>One</title><p>A</p><sec><p>inner</p></sec></sec><sec><p>B</p></sec></body><back><ref>gone</ref></back></article>"


def test_jats(spark):
    got = S.jats_sections(spark.createDataFrame([("p", JATS)], "paper_id string, xml string")).collect()
    assert [(r["section_id"], r["text"]) for r in got] == [("page-001", "Before it."), ("page-002", "One A inner"), ("page-003", "B")]
    for broken in ("<article><body/></article>", "<article/>"):
        with pytest.raises(ValueError):
            S.jats_pages(broken)
    with pytest.raises(SyntaxError):
        S.jats_pages("<article><body>")


def test_html_sections(spark):
    df = spark.createDataFrame([(1, "<p>Lead</p><H2 id='x'>One <b>big</b></H2><p>text</p><h3>Two</h3>")], "page_id long, html string")
    assert [(r["section_ord"], r["heading"], r["text"]) for r in S.html_sections(df).collect()] == [(0, "", "Lead"), (1, "One big", "text"), (2, "Two", "")]


def test_readers_and_sinks(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"case_id":"1","query":"q","expected_terms":["a"],"synthetic":true}\n')
    assert S.benchmark(spark, str(good)).count() == 1
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"case_id":"1","query":"q","expected_terms":["a"],"synthetic":false}\n')
    with pytest.raises(Exception, match="not synthetic"):
        S.benchmark(spark, str(bad)).collect()
    array = tmp_path / "papers.json"
    array.write_text('[{"paper_id":"a","year":2020,"external_ids":{"doi":"10.1/x"}},{"paper_id":"b"}]')
    assert {r["paper_id"] for r in S.json_array(spark, str(array)).collect()} == {"a", "b"}
    rows = spark.createDataFrame([("r", ["e1", "e2"], 0.5)], "relation_id string, evidence_ids array<string>, score double")
    S.export_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["evidence_ids"] == "e1|e2"
    S.export_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["evidence_ids"] == ["e1", "e2"]
    assert S.write_store({n: rows for n in S.STORE}, str(tmp_path / "store")) == {n: 1 for n in S.STORE}
    metrics = spark.createDataFrame([("v", 1.5, float("nan"))], "variant string, a double, b double")
    assert [(r["name"], r["value"]) for r in S.finite_metrics(metrics, "variant").collect()] == [("v.a", 1.5)]
    index = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "i map<string,array<int>>")
    assert index.select(S.abstract_of("i").alias("t")).first()["t"] == "a b a"


def test_rules_as_expressions(spark):
    one = spark.range(1)
    at = lambda c: one.select(c.alias("x")).first()["x"]
    assert at(X.semantic_strength(F.lit("This proves it"))) == "danger"
    assert at(X.semantic_strength(F.lit("we are working on it, and it may"))) == "warning"
    assert at(X.semantic_strength(F.lit("it may be"))) == "info" and at(X.semantic_strength(F.lit("it is"))) == "plain"
    assert at(X.route(F.lit("no key"), evidence_queries.DOMAINS))["domain"] == "general"
    assert at(X.strip_markup(F.lit("a<b>b</b>&amp;lt;  c"))) == "a b &lt; c"
    assert at(X.json_object(F.lit("```json\n{\"a\": 1}\n```")).cast("string")) == '{"a":1}'
    assert at(X.json_object(F.lit("well: {\"a\": 1} ok")).cast("string")) == '{"a":1}'
    assert at(X.context(F.lit("x" * 300), F.lit(100), F.lit(110), 5)) == "x" * 170
    assert at(X.citation_like(F.lit("see Smith (2021)"))) and not at(X.citation_like(F.lit("see it")))
    assert at(X.citation_status(F.lit("Graph"), F.lit("https://x.org/graph"), F.lit("10.1234/ab"))) == "PRELIMINARY"
    assert sorted(at(X.cjk_grams(F.lit("a 科研文 b")))) == sorted(["科研文", "科研", "研文"])


def test_reference_regions(spark):
    rows = [("p", f"page-{k:03d}", 10, 9, k == 2, None) for k in range(1, 7)] + [("q", "page-001", 10, 9, True, "jats-xml-v1"), ("r", "body", 10, 9, False, None)]
    got = S.F and E.reference_regions(spark.createDataFrame(rows, "paper_id string, section_id string, n_sentences int, n_citations int, has_heading boolean, parser string")).where("is_reference").collect()
    assert {(r["paper_id"], r["section_id"]) for r in got} == {("p", f"page-{k:03d}") for k in (2, 4, 5, 6)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"c{k % 3}", "add_support" if k % 2 else "add_refute") for k in range(200)]
    df = spark.createDataFrame(rows, "k long, claim_id string, event_type string").select(F.timestamp_seconds(F.col("k") * 600).alias("ts"), "claim_id", "event_type")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    flow = stream.windowed_decisions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.run_available(flow, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = {tuple(r) for r in stream.windowed_decisions(df).collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = max(b[0] for b in batch)
    assert got <= batch and {b for b in batch if (last - b[0]).total_seconds() > 2 * 3600} <= got


def test_sentence_ends():
    text = "We cite Smith et al. here; it holds. See Fig. 3. U.S. data (v. 2)! Next\nline . Wait... more?! end"
    got = [s for _, _, s in X.split_sentences(text)]
    assert got == ["We cite Smith et al. here;", "it holds.", "See Fig. 3. U.S. data (v. 2)!", "Next", "line .", "Wait... more?!", "end"]
    assert all(text[a:b] == s for a, b, s in X.split_sentences(text))
    assert X.split_sentences("") == [] and X.split_sentences(" \n ; ") == [(3, 4, ";")]


def test_citation_styles(spark):
    yes = ["(2019)", "Smith ET AL", "doi: 10.1/x", "pp. 3", "Vol. 4 no", "arXiv preprint", "[1, 2-4]", "2020. A title", "Smith John, A", "[12] Smith, J", "In Proceedings of", "Journal of Things"]
    no = ["", "plain text with 3 words", "a journal", "in proceedings", "arXiv:1234", "see 12"]
    rows = spark.createDataFrame([(t,) for t in [*yes, *no]] + [(None,)], "t string").select("t", X.citation_like(X.F.col("t")).alias("c")).collect()
    assert [r["t"] for r in rows if r["c"]] == yes
