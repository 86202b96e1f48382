"""Dictionary mentions, triggers, pairs and directions against plain Python."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspan.operators import extraction as E
from lumenspan.operators import mentions as M


def plain_mentions(text, rows, edge="A-Za-z0-9"):
    """Every alias's pattern in turn, longest first; a match that meets an earlier one is passed over."""
    taken = []
    for alias, concept, _ in rows:
        body = re.escape(alias)
        if re.fullmatch(r"[A-Za-z0-9 _\-/]+", alias):
            body = rf"(?<![{edge}]){body}(?![{edge}])" if edge != "unicode" else rf"(?<![^\W_]){body}(?![^\W_])"
        for m in re.finditer(body, text or "", re.IGNORECASE):
            if all(m.end() <= a or b <= m.start() for a, b, _ in taken):
                taken.append((m.start(), m.end(), concept))
    return sorted(taken)


def found(spark, texts, dictionary, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = M.located(rows, dictionary, **how).collect()
    return [[(m["char_start"], m["char_end"], m["concept"]) for m in r["mentions"]] for r in sorted(got, key=lambda r: r["id"])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbK -_éſßİ图谱K."), st.lists(st.text(alphabet="abk -é图s", min_size=1, max_size=4), min_size=1, max_size=8))
def test_greedy_choice_equals_patterns(text, aliases):
    rows = M.entries([(a, a, None) for a in aliases])
    if rows:
        got = M.Finder(rows, "ascii").mentions(text, [])
        assert [(b, e, rows[k][0]) for b, e, k in got] == plain_mentions(text, rows)


TEXTS = [
    None, "", "graph neural network and Graph network, graphs", "知识图谱和图谱构建", "naïve Bayes, naïve", "eﬁx fix", "a a a a a", "the The THE", "x" * 50_000 + " graph " * 20_000, "end graph",
]


@pytest.mark.parametrize("boundary", ["ascii", "unicode"])
def test_texts_and_boundaries(spark, boundary):
    dictionary = [("graph", 0), ("graph neural network", 1), ("network", 2), ("图谱", 3), ("知识图谱", 4), ("ve", 5), ("x fix", 6), ("x", 7), ("a a", 8), ("the", 9), ("THE", 10), ("  ", 11), ("", 12)]
    rows = M.entries(dictionary)
    edge = "A-Za-z0-9" if boundary == "ascii" else "unicode"
    assert found(spark, TEXTS, dictionary, boundary=boundary) == [plain_mentions(t, rows, edge) for t in TEXTS]
    assert found(spark, TEXTS, []) == [[]] * len(TEXTS)
    assert M.located(spark.createDataFrame([], "text string"), dictionary).count() == 0
    with pytest.raises(ValueError):
        M.located(spark.createDataFrame([("a", 1)], "text string, mentions int"), dictionary)


def big_dictionary(n):
    rng = random.Random(n)
    syllables = [a + b for a in "bcdfgl" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    return word, sorted({(" ".join(word() for _ in range(rng.randrange(1, 4))), "c") for _ in range(n)})


def test_parts_of_a_dictionary_give_what_one_gives(spark, monkeypatch):
    word, dictionary = big_dictionary(1500)
    dictionary = [(a, f"{c}{k % 97}", f"t{k % 5}") for k, (a, c) in enumerate(dictionary)]
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = M.entries(dictionary)
    want = [plain_mentions(t, rows) for t in texts]
    assert sum(map(len, want)) > 200
    assert found(spark, texts, dictionary) == want
    monkeypatch.setattr(M, "AUTOMATON_CHARS", 4000)
    assert len(list(M.parts(rows, 4000))) > 3
    assert found(spark, texts, spark.createDataFrame(dictionary, "alias string, concept string, type string")) == want
    monkeypatch.setattr(M, "DICTIONARY_CHARS", 1000)
    with pytest.raises(ValueError):
        M.located(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame(dictionary, "alias string, concept string, type string"))


def test_time_does_not_grow_with_the_dictionary():
    """A text with few matches is searched about as fast for 20,000 aliases as for 100."""
    text = "zzz yyyy qqqq wwww " * 20_000
    seconds = []
    for n in (100, 20_000):
        finder = M.Finder(M.entries(big_dictionary(n)[1]), "ascii")
        best = 9.0
        for _ in range(3):
            begin = time.perf_counter()
            finder.hits(text)
            best = min(best, time.perf_counter() - begin)
        seconds.append(best)
    assert seconds[1] < 4 * seconds[0]


def test_mentions_and_their_ids(spark):
    rows = spark.createDataFrame([("e1", 1, "graph neural network and Graph network, graphs"), ("e2", 1, None)], "evidence_id string, paper_id long, text string")
    got = E.mentions(rows, [("graph", 0), ("graph neural network", 1), ("network", 2)]).orderBy("char_start").collect()
    assert [(r["concept"], r["char_start"], r["char_end"]) for r in got] == [("1", 0, 20), ("0", 25, 30), ("2", 31, 38)]
    assert len({r["mention_id"] for r in got}) == 3


def plain_pairs(mentions, triggers, window=40):
    once = {}
    for m in sorted(mentions):
        once.setdefault(m[2], m)
    ordered, out = sorted(once.values()), []
    for i, s in enumerate(ordered):
        for t in ordered[i + 1 :]:
            fit = [k for a, b, k in triggers if s[1] <= a and b <= t[0] or b <= s[0] and s[0] - b <= window or t[1] <= a and a - t[1] <= window]
            if fit:
                out.append((s[2], t[2], fit[0]))
    return out


def test_triggered_pairs_equal_plain_python(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma ray", "delta", "uses", "Used  in", "supports", "用于", "pad" * 8, "because", "x"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, ""]
    dictionary = [("alpha", "a", "M"), ("beta", "b", "T"), ("gamma ray", "g", "D"), ("gamma", "a", "M"), ("delta", "d", None)]
    triggers = [("USES", ("uses", "used in", "用于", "use")), ("SUPPORTS", ("supports", "uses"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    placed = M.triggered(M.located(rows, dictionary), triggers).collect()
    want = []
    for r in placed:
        hits = []
        for kind, some in triggers:
            for t in some:
                body = re.escape(t).replace(r"\ ", r"\s+")
                edge = re.fullmatch(r"[A-Za-z0-9 _\-/]+", t)
                hits += [(*m.span(), kind) for m in re.finditer(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])" if edge else body, r["text"] or "", re.I)]
        hits.sort(key=lambda h: h[:2])
        assert [tuple(t) for t in r["triggers"]] == hits
        want += [(r["id"], *p) for p in plain_pairs([tuple(m)[:3] for m in r["mentions"]], hits)]
    got = M.pairs(M.triggered(M.located(rows, dictionary), triggers), 40, "id").select("id", "source", "target", "type").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    near = M.pairs(M.triggered(M.located(rows, dictionary), triggers), 3, "id").count()
    assert 0 < near < len(want)


def test_direction_by_constraints(spark):
    rows = spark.createDataFrame(
        [("a", "M", "b", "T", "USES"), ("b", "T", "a", "M", "USES"), ("b", "T", "c", "T", "USES"), ("m", "M", "n", "M", "LIKES"), ("b", "T", "a", "M", "OTHER"), ("b", None, "a", "M", "USES"), ("b", "T", "a", "M", None)],
        "source string, source_type string, target string, target_type string, type string",
    )
    got = sorted((r["source"], r["target"], r["type"] or "") for r in M.oriented(rows, {"USES": (("M",), ("T",)), "LIKES": (("M",), ("M",))}).collect())
    assert got == sorted([("a", "b", "USES"), ("a", "b", "USES"), ("b", "c", "USES"), ("m", "n", "LIKES"), ("b", "a", "OTHER"), ("b", "a", "USES"), ("b", "a", "")])


def test_relations_count_evidence(spark):
    rows = spark.createDataFrame([("e1", "a", "b")] * 2 + [("e2", "a", "b"), ("e3", "a", "b"), ("e1", "a", "c")], "evidence_id string, source string, target string").withColumns({"type": F.lit("USES"), "source_type": F.lit("M"), "target_type": F.lit("T")})
    got = {r["target"]: (r["n_evidence"], r["confidence"]) for r in M.relations(rows).collect()}
    assert got == {"b": (3, 0.87), "c": (1, 0.78)}
