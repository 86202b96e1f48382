"""Unwrapped pages against plain Python over whole documents."""

import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from lumenspan.operators import pages as P
from lumenspan.plans import acceptance_queries as Q
from lumenspan.session import load


def plain(pages, ends=P.LINE_ENDS):
    words = defaultdict(set)
    for d, _, t in pages:
        words[d] |= {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z'\-]*", t or "")}
    return [(d, p, None if t is None else P.unwrap(t, words[d], ends)) for d, p, t in pages]


def test_rules():
    words = {"comprehensive", "state-of-the-art", "re-use", "reuse"}
    cases = {
        "a com-\nprehensive view\nof it.\nNext": "a comprehensive view of it.\nNext", "a state-\nof-the-art\nthing": "a state-of-the-art thing", "re-\nuse": "re-use", "un-\nseen": "unseen", "Smith-\nJones": "Smith-Jones",
        "pre-\n2020 rules": "pre2020 rules", "1-\n2": "1-2", "": "", " \n\t\r\n": "", "a;\r\nb\rc": "a;\nb c", "end-": "end-", "中文。\n下一": "中文。\n下一",
    }
    for text, want in cases.items():
        assert P.unwrap(text, words) == want
    assert P.unwrap("one.\ntwo", set(), "") == "one. two"


def test_pages_of_documents(spark):
    pages = [("d", 1, "a com-\nprehensive view of state-\nof-the-\nart"), ("d", 2, "Comprehensive and state-of-the-art"), ("e", 1, "com-\nprehensive com-prehensive"), (None, 1, "x-\ny"), (None, 2, "x-y"), ("d", 3, None), ("d", 3, ""), ("f", 1, "a-\nb\nc-")]
    df = spark.createDataFrame(pages, "document_id string, page int, text string")
    for ends in (P.LINE_ENDS, ""):
        got = [tuple(r) for r in P.unwrapped(df, ends).collect()]
        assert sorted(map(str, got)) == sorted(map(str, plain(pages, ends)))
    extra = df.withColumns({"word": F.lit(1), "piece": F.lit(2), "lines": F.lit(3), "k": F.lit(4)})
    assert P.unwrapped(extra).columns == extra.columns and P.unwrapped(extra).count() == len(pages) and P.unwrapped(df.limit(0)).count() == 0


def test_query_equals_plain_python(spark, sf):
    wrapped = F.regexp_replace(F.regexp_replace("text", r"(.{28}[a-z]{2,6})([a-z]{2,6}\b)", "$1-\n$2"), r"(.{38}) ", "$1\n")
    rows = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("d"), "doc_id", wrapped.alias("t")).collect()
    got = sorted(tuple(r) for r in Q.unwrapped_pages(spark, sf).collect())
    assert got == sorted(plain([tuple(r) for r in rows])) and sum("-\n" in (r["t"] or "") for r in rows) > 100


def test_long_page_takes_time_in_proportion():
    """F8: every break looked through all that was joined before it."""
    text = "\n".join(f"some words that wrap {k} syl-\nlable" for k in range(60_000))
    begun = time.time()
    got = P.unwrap(text, {"some", "syl", "lable"})
    assert got.count("syllable") == 60_000 and "-" not in got and time.time() - begun < 10


def test_only_hyphened_words_are_sent(spark):
    """F8: every word that ends as a break does was sent to its document's pages; only those with the hyphen tell."""
    pages = [(1, 1, "a re-\nuse of chained w-\nx-\ny and pre-\x1c\n\x1fset"), (1, 2, "reuse re-use w-x-y abuse use pre-set PRE-SET"), (2, 1, "re-\nuse")]
    df = spark.createDataFrame(pages, "document_id long, page int, text string")
    assert sorted(tuple(r) for r in P.unwrapped(df).collect()) == sorted(plain(pages))
    held = {}
    kept = P.stored
    try:
        P.stored = lambda frame, name: held.setdefault(name, kept(frame, name))
        P.unwrapped(df).collect()
    finally:
        P.stored = kept
    assert {w for r in held["words"].collect() for w in r["_words"]} == {"re-use", "w-x-y", "pre-set"}
