"""I-Match against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import imatch
from lumenspan.session import load


def slow_terms(text):
    return {t for t in re.split(r"[^\w]+|_+", (text or "").lower()) if t}


def neighbours(rows):
    """(doc_id, text, next text) in descending order of doc_id."""
    rows = sorted(rows, key=lambda r: r[0], reverse=True)
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def check(spark, docs, low, high):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    n = len(rows)
    df = Counter(t for _, text in rows for t in slow_terms(text))
    inside = {t for t, c in df.items() if max(1, low * n) <= c <= max(1, high * n)}
    words = {(r["t"], r["subset"]) for r in imatch.lexicon(docs, low, high).join(
        spark.createDataFrame([(t,) for t in df] or [("",)], "t string").withColumn("term", F.xxhash64("t")), "term").collect()}
    assert {t for t, _ in words} == inside
    held = {}
    for t, s in words:
        held.setdefault(s, set()).add(t)

    def values(text):
        own = slow_terms(text)
        out = tuple(frozenset(own & held.get(s, set())) for s in range(imatch.SUBSETS))
        return out if any(out) else (frozenset(own) | {None},) * imatch.SUBSETS

    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs, low, high).collect()}
    assert len(got) == n
    prints = {}
    for doc, text, following in neighbours(rows):
        r = got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, next_ = values(text), values(edited), values(following)
        for near, a, b in (("near_edited", own, other), ("near_next", own, next_)):
            used = [(x, y) for x, y in zip(a, b) if x or y]
            assert r[near] == pytest.approx(sum(x == y for x, y in used) / len(used), abs=0.02)
        for value, shown in ((own, r["fingerprint"]), (other, r["edited_fingerprint"])):
            assert len(shown) == 4 * imatch.SUBSETS
            assert prints.setdefault(value, shown) == shown
            assert [shown[k : k + 4] == "0000" for k in range(0, len(shown), 4)] == [not v for v in value]
    return got


def test_documents(spark, sf):
    got = check(spark, load(spark, sf, "documents"), 0.02, 0.2)
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.85 * len(got)


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_odd_documents(spark, odd_docs, no_docs, block_rows, monkeypatch):
    monkeypatch.setattr(imatch, "BLOCK_ROWS", block_rows)
    check(spark, odd_docs, 0.1, 0.9)
    assert imatch.edited_fingerprints(no_docs).count() == 0
    one = odd_docs.where("doc_id = 3")
    assert imatch.edited_fingerprints(one).first()["near_next"] == 1.0


def test_equal_texts_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b c d e"), (1, "a c x"), (None, "b c d e"), (9, "b  c, D E")], "doc_id long, text string")
    got = [r for r in imatch.edited_fingerprints(docs).collect()]
    assert len(got) == 4
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (None, 9)}) == 1
    assert {(r["doc_id"], r["fingerprint"]) for r in imatch.fingerprints(docs).collect()} == {(r["doc_id"], r["fingerprint"]) for r in got}


def test_texts_without_lexicon_terms_differ(spark):
    """At 16 bits, 2,000 such texts gave about 30 pairs of equal fingerprints."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("left"), "id", F.lit(" right"), "id").alias("text"))
    assert imatch.lexicon(docs).count() == 0
    assert imatch.fingerprints(docs).select("fingerprint").distinct().count() == 2000


def test_main_path_runs_no_python(spark, sf):
    plan = imatch.edited_fingerprints(load(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hashed_and_shared_ids_make_even_blocks(spark, monkeypatch):
    """64-bit hashes as ids, and an id that a third of all rows share: no block of neighbours grows with either."""
    monkeypatch.setattr(imatch, "BLOCK_ROWS", 50)
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, 77)).otherwise(F.xxhash64("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    blocks = [r["count"] for r in imatch._blocks(ids).groupBy("_block").count().collect()]
    assert len(blocks) >= 40 and max(blocks) < 250
    rows = sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"], r["_h"], r["text"]) for r in ids.withColumn("_h", F.xxhash64("text")).collect()), reverse=True)
    want = {t: rows[(k + 1) % len(rows)][2] for k, (_, _, t) in enumerate(rows)}
    assert {r["text"]: r["next_text"] for r in imatch.neighbours(ids).collect()} == want
