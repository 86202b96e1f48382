"""Review, mining and concept-merge operators against hand-made expectations."""

from pyspark.sql import functions as F

from lumenspan.operators import review as V


def test_direction(spark):
    relations = spark.createDataFrame([("r1", "A", "B", "e1"), ("r2", "A", "B", "e2")], "relation_id string, source string, target string, evidence_id string")
    mentions = spark.createDataFrame([("e1", "A", 20), ("e1", "B", 0), ("e2", "A", 0), ("e2", "B", 20)], "evidence_id string, concept string, char_start int")
    triggers = spark.createDataFrame([("e1", 10), ("e2", 10)], "evidence_id string, at int")
    assert [r["relation_id"] for r in V.direction_faults(relations, mentions, triggers).collect()] == ["r1"]


def test_policy(spark):
    rows = [("graph", "task", "The graph model solves the task here.", ["METHOD"], ["TASK"], "METHOD", "TASK", "solves"), ("graph", "task", "The graphs and the tasks are listed.", None, None, "X", "Y", ""), ("a+b", "task", "We use a+b for the task, as shown.", ["TASK"], ["TASK"], "METHOD", "TASK", "use")]
    df = spark.createDataFrame(rows, "source string, target string, sentence string, sources array<string>, targets array<string>, source_type string, target_type string, trigger string")
    got = [r["faults"] for r in V.accepted_by_policy(df).collect()]
    assert got == [[], ["source_located", "target_located", "trigger"], ["types"]]
    assert V.accepted_by_policy(df, strict=False).collect()[1]["faults"] == ["source_located", "target_located"]


def test_mining(spark):
    text = "We propose the Deep Graph Net model. It uses CGCNN here. Results with Deep Graph Net show that CGCNN improves on MP2020."
    terms = {t: k for t, k, _ in V.mine_terms(text)}
    assert terms["Deep Graph Net"] == "METHOD" and "CGCNN" in terms
    found = V.mine_relations(text)
    assert ("Deep Graph Net", "IMPROVES", "CGCNN") in {r[:3] for r in found} and all(0.5 < r[3] <= 0.68 for r in found)
    docs = spark.createDataFrame([("p1", text), ("p2", None), ("p3", "plain words only.")], "paper_id string, text string")
    generic = V.generic_relations(docs)
    assert {r["paper_id"] for r in generic.collect()} == {"p1"}
    guided = generic.where("false").union(spark.createDataFrame([("p9", 0, "a", "USES", "b", 0.8)], generic.schema))
    assert {(r["paper_id"], r["miner"]) for r in V.with_fallback(guided, generic).collect()} == {("p1", "generic"), ("p9", "schema")}


def test_fragments():
    assert V.fragment_reason("", "X") == "empty"
    assert V.fragment_reason("PCA of the PCA", "PCA") == "acronym_repeated"
    assert V.fragment_reason("graph net graph net", "GN") == "repeated_phrase"
    assert V.fragment_reason("using graph net", "GN") == "leading_word"
    assert V.fragment_reason("scanning electron microscopy", "SEM") == ""


def test_concepts(spark):
    rows = [(1, "Graph Networks", "METHOD"), (2, "graph-network", "METHOD"), (3, "Graph network", "TASK"), (4, "GN", "METHOD"), (5, "lone", "TASK"), (6, "principal component analysis", "METHOD"), (7, "Principal-Component Analysi", "METHOD")]
    df = spark.createDataFrame(rows, "concept_id long, name string, type string")
    names = spark.createDataFrame([("PCA", "principal component analysis", 6), ("PCA", "Principal-Component Analysi", 7), ("PCA", "using something else", 5)], "acronym string, full_name string, concept_id long")
    got = {r["concept_id"]: (r["group_id"], r["verdict"]) for r in V.merged_concepts(df, names).collect()}
    assert got == {1: (1, "type_conflict"), 2: (1, "type_conflict"), 3: (1, "type_conflict"), 4: (4, "single"), 5: (5, "single"), 6: (6, "merged"), 7: (6, "merged")}


def test_lines():
    page = "The meth-\nod works well\nin practice.\n\nA method and a state-\nof-the-art one"
    assert V.unwrapped(page) == "The method works well in practice.\n\nA method and a state-of-the-art one"


def test_rewrites_and_highlights(spark):
    one = spark.range(1)
    got = one.select(V.humanized(F.lit("In order to utilize it, moreover, we try"), "medium").alias("m"), V.humanized(F.lit("moreover, we try"), "heavy").alias("h"), V.highlights(F.lit("A graph and GRAPHS"), F.lit("Graph"), F.lit("graph and")).alias("x")).first()
    assert got["m"] == "to use it, moreover, we try" and got["h"] == "we try"
    assert (got["x"]["head_at"], got["x"]["tail_at"]) == (3, 0)


def test_services(spark, tmp_path):
    from lumenspan.operators import services as S

    assert S.boundary_sentences("One thing. Two by Smith et al. Three! 4 is next") == ["One thing.", "Two by Smith et al. Three!", "4 is next"]
    got = spark.range(1).select(S.capitalised(F.lit("We use Graphs and CGCNN here. Then Networks fail")).alias("c"), S.numbers(F.lit("0.89 of 1,000 and 5%")).alias("n")).first()
    assert got["c"] == ["cgcnn", "graph", "network"]  # We and Then begin sentences
    assert sorted(got["n"]) == ["0.89", "1,000", "5%"]
    rows = spark.createDataFrame([(1, '{"a": "x", "n": 1}'), (2, '{"a": 3, "n": 1}'), (3, "["), (4, '{"a": "x", "n": true}'), (5, None)], "id long, body string")
    assert {r["id"]: r["fault"] for r in S.schema_faults(rows, {"a": "string", "n": "number"}).collect()} == {1: "", 2: "a", 3: "not JSON", 4: "n", 5: "not JSON"}
    (tmp_path / "f.txt").write_text("abc")
    assert [(r["size"], r["sha256"]) for r in S.inventory(spark, str(tmp_path)).collect()] == [(3, "ba7816bf8f01")]
    assert S.receipt(rows).first() == S.receipt(rows.repartition(3)).first() != S.receipt(rows.where("id < 5")).first()
