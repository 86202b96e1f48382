"""Fill-in-the-middle against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspan.llm import fim
from lumenspan.session import load


def plain(doc_id, text):
    text = text or ""
    found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(found), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(found[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


def check(docs):
    got = fim.digests(fim.transformed(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    want = [plain(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_documents(spark, sf):
    check(load(spark, sf, "documents"))


def test_odd_documents(spark, odd_docs, no_docs):
    check(odd_docs)
    check(odd_docs.union(odd_docs).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))))
    assert fim.transformed(no_docs).count() == 0
    more = [(k, t) for k in range(60) for t in ("a<P>b", "a<S", "<", "<P", "S><M", "é<S>", "ab", "é", "x y", "ß" * 70 + "abc" * 30)]
    check(spark.createDataFrame(more, "doc_id long, text string").withColumns({"n": F.lit(1), "output": F.lit("x"), "form": F.lit("y"), "h1": F.lit(0)}))


def test_text_longer_than_a_slice(spark):
    check(spark.createDataFrame([(5, "Wörter und mehr, " * 500_000), (6, "short"), (7, "x" * 7_000_000)], "doc_id long, text string"))


def test_marks_come_back(spark):
    docs = spark.createDataFrame([(k, t) for k in range(200) for t in ("a<", "<S<", "P>x", "<<M")], "doc_id long, text string")
    rows = fim.transformed(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert {r["back"] for r in rows.collect()} == {"a<", "<S<", "P>x", "<<M"}


def test_rank_and_select():
    rng = random.Random(3)
    for size, share in ((1, 1), (7, 0.5), (512, 0.5), (513, 0.02), (5000, 0.001), (70_000, 0.3), (4096, 1)):
        bits = np.array([rng.random() < share for _ in range(size)], bool)
        made, places = fim.Bits(bits), np.arange(size + 1)
        assert (made.rank(places) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (made.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()
    assert fim.Bits(np.zeros(0, bool)).rank(np.array([0])).tolist() == [0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aZ éß日🙂.\n<"), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1))
def test_cuts_equal_tokens(rows):
    got = fim.cuts(pa.array([t for t, _, _ in rows]), np.array([a for _, a, _ in rows]), np.array([b for _, _, b in rows]))
    for (text, a, b), n, low, high, before, upto in zip(rows, *(x.tolist() for x in got)):
        found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        cuts = sorted((a % (len(found) + 1), b % (len(found) + 1)))
        assert n == len(found)
        assert [low, high] == [len("".join(found[:k]).encode()) for k in cuts]
        assert [before, upto] == [len("".join(found[:k])) for k in cuts]
