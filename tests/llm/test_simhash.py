"""SimHash fingerprints and links against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.llm import simhash
from lumenspan.session import load


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(docs):
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = slow_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(prints)
    for r in got:
        assert r["fp"] & (2**64 - 1) == prints[r["doc_id"]]
        assert r["component_id"] == want[r["doc_id"]]
    return want


def test_documents(spark, sf):
    want = check(load(spark, sf, "documents"))
    assert len(set(want.values())) < len(want)


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "z"), (7, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (7, 7), (None, 5), (None, None)], key=str)


@pytest.mark.parametrize("limit", [simhash.SHARD_ROWS, 40])
def test_links_of_clustered_and_random_points(spark, limit, monkeypatch):
    """With a small limit every shard is dealt into blocks; the components stay the same."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", limit)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    values = {int(x) for x in rng.integers(0, 2**63, 300)} | {centre}
    for _ in range(300):  # chains that leave the centre bit by bit
        base = list(values)[int(rng.integers(0, len(values)))]
        for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            base ^= 1 << int(bit)
        values.add(base)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    points = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, rep long")
    want = slow_components(dict(enumerate(values)))
    found = {r["node"]: r["component"] for r in simhash.connected_components(simhash.links(points, len(values))).collect()}
    assert {i: found.get(i, i) for i in want} == want


@given(st.integers(0, 2**32), st.integers(2, 120))
@settings(max_examples=40, deadline=None)
def test_leaf_search(seed, n):
    rng = np.random.default_rng(seed)
    points = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64(0x00FF00FF0F0F0003))
    home = rng.random(len(points)) < 0.6
    old, simhash.LEAF = simhash.LEAF, 64
    try:
        root = simhash.join_near(points, home)
    finally:
        simhash.LEAF = old
    want = list(range(len(points)))
    for i in range(len(points)):
        for j in range(len(points)):
            if home[i] and int(points[i] ^ points[j]).bit_count() <= 3:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert root.tolist() == want
