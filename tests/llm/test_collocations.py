"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import collocations as C
from lumenspan.session import load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, share=50, top=2000):
    counts, out = {}, []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            into = counts.setdefault(lang or "und" if lang is None else lang, Counter())
            for size in (1, 2, 3):
                into.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        longer = {}
        for p, c in f.items():
            if len(p) == 3 and c >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer.get(part, 0), c)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and 100 * longer.get(p, 0) >= share * a):
                score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def check(docs, **how):
    want = plain([(r["lang"], r["text"]) for r in docs.collect()], **how)
    assert sorted(map(tuple, C.collocations(docs, **how).collect())) == want
    return want


def test_documents(spark, sf):
    assert len(check(load(spark, sf, "documents"))) > 100


def test_many_scans(spark, sf, monkeypatch):
    """Several slices, a small table of levels, small automata and a second round of counting give the same rows."""
    docs = load(spark, sf, "documents")
    want = sorted(map(tuple, C.collocations(docs, top=50).collect()))
    monkeypatch.setattr(C, "LOAD", 0.05)  # several slices
    monkeypatch.setattr(C, "ENTRIES", 4096)  # most phrases pass, and the cells tell
    monkeypatch.setattr(C, "PATTERN_CHARS", 20_000)
    monkeypatch.setattr(C, "AHEAD", 1)
    assert sorted(map(tuple, C.collocations(docs, top=50).collect())) == want


def test_odd_documents(spark, odd_docs, no_docs):
    check(odd_docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("en"))))
    check(odd_docs.union(odd_docs), least=2)
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(odd_docs.select(F.lit(None).cast("string").alias("text"), "lang")).count() == 0


@pytest.mark.parametrize("floors", [(100_000, 0), (900_000, 1000, 0), (0,)])
def test_floors_change_nothing(spark, floors, monkeypatch):
    """One language has enough strong phrases at the floor, one has not; long phrases below it still drop short ones."""
    rng = random.Random(9)
    common = [f"c{k}" for k in range(5)]
    rows = [("en", " ".join(rng.choice([*common, f"x{rng.randrange(40)} y{rng.randrange(3)}", "the rare pair"]) for _ in range(80))) for _ in range(60)]
    rows += [("de", " ".join(rng.choice(common) for _ in range(80))) for _ in range(60)] + [("en", f"solo{k} duo{k}") for k in range(30)] * 12
    monkeypatch.setattr(C, "FLOORS", floors)
    monkeypatch.setattr(C, "FREQUENT", 20)
    check(spark.createDataFrame(rows, "lang string, text string"), top=20)


def test_overlaps_pieces_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "und", None, ""]), " ".join(rng.choice(["a", "B", "b.", "c,d", "é\tÉ", "a\x1ca", "x!", "A", "\xa0"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", "la la la la la"), ("en", "new york city"), ("en", "New York")] * 12 + [("en", "x" * 200_000 + " and the end")] * 10
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit(1), "a": F.lit(2), "shard": F.lit(3)})
    check(docs)
    check(docs, least=3, share=80, top=7)


def test_runs_overlap(monkeypatch):
    """Numbering words in short runs loses and repeats no phrase."""
    rng = random.Random(1)
    words = [rng.choice([b"a", b"b", b"c", C.GUARD]) for _ in range(500)]
    want = Counter()
    for size in (2, 3):
        want.update(t for i in range(len(words) - size + 1) if C.GUARD not in (t := tuple(words[i : i + size])))
    for run in (1, 2, 7, 10_000):
        monkeypatch.setattr(C, "RUN", run)
        got = Counter()
        for g in C.grams("en", words):
            for c, p in zip(g.counts.tolist(), g.places.tolist()):
                got[tuple(g.run[p : p + g.size])] += c
        assert got == want


def test_sketch_bounds_counts_from_above(spark, sf):
    docs = load(spark, sf, "documents")
    counts = Counter()
    for r in docs.collect():
        for g in C.grams(r["lang"], C.guarded([r["text"].encode()])):
            counts.update({(r["lang"], b" ".join(g.run[p : p + g.size])): c for p, c in zip(g.places.tolist(), g.counts.tolist())})
    listed = {(r["lang"], r["phrase"].encode()): r["bound"] for r in C.Sketch(docs, C.word_counts(docs), 10).candidates(docs).collect()}
    assert all(listed[p] >= c for p, c in counts.items() if c >= 10)


@pytest.mark.parametrize("size", [10**6, 3 * 10**9])
def test_products_pass_64_bits(spark, size):
    got = spark.createDataFrame([(size, size + 7, size * 2)], "a long, l long, r long").select(C.score_of("a", "l", "r").alias("s")).first()["s"]
    assert got == 1000000 * size * size // ((size + 7) * (size * 2))


def test_hashes_of_phrases_differ():
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(w) for w in (b"a", b"b", b"c")], np.uint64)
    a, b, c = (h[k : k + 1] for k in range(3))
    assert len({int(C.hashed("en", x)[0]) for x in ([a, b], [b, a], [a, b, c], [c, b, a], [a, a])}) == 5
    assert C.hashed("en", [a, b])[0] != C.hashed("de", [a, b])[0]
