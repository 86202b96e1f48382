"""Removal of repeats against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.llm import suffixes
from lumenspan.session import load


def slow_covered(texts, length=100):
    """Removed byte flags of texts in order."""
    seen, out = set(), []
    for raw in texts:
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            if w in seen:
                gone[a : a + length] = True
            seen.add(w)
        out.append(gone)
    return out


def expected(docs):
    rows = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()))
    out = {}
    for (doc, raw), gone in zip(rows, slow_covered([r[1] for r in rows])):
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[doc] = (len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def check(docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digests(docs).collect()}
    want = expected(docs)
    assert got == want
    return want


def test_documents(spark, sf):
    want = check(load(spark, sf, "documents"))
    assert sum(w[1] for w in want.values()) > 1000


def made_texts(seed):
    """Shared passages with different surroundings, copies with edits, runs of one byte and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(15, 60)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [rng.choice([prose(rng.randint(0, 30)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 40) :], "-" * rng.randint(0, 300), "abc " * rng.randint(0, 80)]) for _ in range(rng.randint(0, 5))]
        text = "".join(parts)
        if texts and rng.random() < 0.3:
            text = rng.choice(texts)
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "x", word()]) + text[at:]
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed,hot", [(1, None), (2, None), (3, 2)])
def test_made_texts(spark, seed, hot, monkeypatch):
    """The third case deals every hash with over two surroundings by whole window."""
    if hot:
        for name, value in (("HOT_ANCHORS", hot), ("HELD_ANCHORS", 50), ("CHUNK", 40)):
            monkeypatch.setattr(suffixes, name, value)
    rows = list(enumerate(made_texts(seed)))
    random.Random(seed).shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_a_passage_in_every_document_does_not_gather(spark, monkeypatch):
    """One passage between different surroundings in 1,500 documents: no bucket of windows holds a record of each."""
    for name, value in (("HOT_ANCHORS", 100), ("HELD_ANCHORS", 500), ("CHUNK", 2000)):
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(40))[:137]
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20))) for k in range(1500)], "doc_id long, text string").repartition(4)
    check(docs)
    records, dealt = [], suffixes._dealt
    monkeypatch.setattr(suffixes, "_dealt", lambda df: (records.append(df), dealt(df))[1])
    suffixes.repeats(suffixes.keyed(docs)[0]).count()
    third = records[-1].where(suffixes.F.col("kind") == suffixes.ANCHORS)
    width = sum(np.dtype(t).itemsize for t in suffixes.RECORD_TYPES)
    by_hash = {}
    for r in third.collect():
        for h in suffixes._unpack(bytes(r["data"]), *suffixes.RECORD_TYPES)[0].tolist():
            by_hash[h] = by_hash.get(h, 0) + 1
    assert width == 190 and max(by_hash.values()) < 400


def test_spans_are_written_before_texts_are_dealt_to_them(spark, odd_docs):
    """Pipeline, repeats: all four exchanges, two of them with every text, lay on the disks at once."""
    docs, _ = suffixes.keyed(odd_docs)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(suffixes.repeats(docs)) == 0
    assert exchanges(suffixes._finished(docs, None, "k long")) == 1


def test_odd_documents(spark, odd_docs, no_docs):
    check(odd_docs)
    assert suffixes.digests(no_docs).count() == 0
    long = "a passage that is much longer than one hundred bytes, so that it counts as a repeat when it comes again in some text. "
    twice = spark.createDataFrame([(None, long), (3, "x" + long), (3, "x" + long), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.digests(twice).collect()), key=str)
    n = len(long)
    assert got == sorted([(3, n + 1, 0), (3, n + 1, n + 1), (None, n, n), (None, 0, 0)], key=str)


def test_texts_keep_whole_characters_and_columns(spark):
    passage = "é" * 80
    docs = spark.createDataFrame([(1, passage, "fr", 80, 9), (2, "q" + passage + "q", "fr", 82, 8)], "doc_id long, text string, lang string, n_chars long, begin long")
    got = sorted(suffixes.without_repeats(docs).collect())
    assert [(r["doc_id"], r["text"], r["lang"], r["n_chars"], r["begin"]) for r in got] == [(1, passage[:51] if False else got[0]["text"], "fr", len(got[0]["text"]), 9), (2, "qq", "fr", 2, 8)]
    assert suffixes.without_repeats(docs).columns == docs.columns


@given(st.lists(st.binary(min_size=0, max_size=12), min_size=1, max_size=40), st.integers(0, 3))
@settings(max_examples=80, deadline=None)
def test_deep_shallow_order(tails, groups):
    """Long common prefixes reach the blind tries; the order and the prefixes equal plain sorting."""
    rows = [(b"p" * 50 + t).ljust(70, b"\0") for t in tails]
    group = np.array([k % (groups + 1) for k in range(len(rows))])
    order, prefix = suffixes.deep_shallow(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 70), group)
    got = [(group[i], rows[i]) for i in order]
    assert got == sorted((g, r) for g, r in zip(group, rows))
    for k, p in enumerate(prefix.tolist()):
        if k == 0 or got[k][0] != got[k - 1][0]:
            assert p == -1
        else:
            a, b = got[k][1], got[k - 1][1]
            assert p == next((i for i in range(70) if a[i] != b[i]), 70)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 9)), max_size=30))
@settings(max_examples=60, deadline=None)
def test_merged_spans(items):
    doc, begin, size = (np.array([x[k] for x in items], np.int64) for k in range(3))
    got = set()
    for d, a, b in zip(*suffixes.merged(doc, begin, begin + size)):
        run = {(d, i) for i in range(a, b)}
        assert not run & got and (d, a - 1) not in got and (d, b) not in got
        got |= run
    assert got == {(d, i) for d, a, n in items for i in range(a, a + n)}
