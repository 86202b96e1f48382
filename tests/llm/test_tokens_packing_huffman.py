"""Token ids, best-fit packing and coded blocks against the tokenizers library and plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenspan.llm import huffman, packing
from lumenspan.llm.tokens import encoder, tokenizer_path
from lumenspan.session import load

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sabcDEé1<|>. "), st.characters(codec="utf-8")), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(name, texts):
    coder = encoder(tokenizer_path(name))
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in coder.slow.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == want


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library_on_documents(name, spark, sf):
    texts = [r["text"] for r in load(spark, sf, "documents").select("text").collect()]
    coder = encoder(tokenizer_path(name))
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in coder.slow.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def expected_tokens(docs, name, end):
    slow = Tokenizer.from_file(tokenizer_path(name))
    return {r["doc_id"]: [*slow.encode(r["text"] or "", add_special_tokens=False).ids, end] for r in docs.select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(docs):
    want = expected_tokens(docs, FILES[0], 2)
    rows = packing.best_fit(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for doc, got in by_doc.items():
        got.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        assert all(r["length"] == 1024 for r in got[1:])
        at = 0
        for r in got:
            assert r["start"] == at and r["ids_crc32"] == crc(want[doc][at : at + r["length"]])
            at += r["length"]
        assert at == len(want[doc])
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return by_sequence, rows


def test_packing_documents(spark, sf):
    by_sequence, rows = check_packing(load(spark, sf, "documents"))
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 1024) + 2


def test_packing_odd_documents(odd_docs, no_docs):
    check_packing(odd_docs)
    assert packing.best_fit(no_docs).count() == 0


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 1)), max_size=60), st.lists(st.integers(0, 60), max_size=6))
@settings(max_examples=200, deadline=None)
def test_sweeps_of_ranges_equal_one_sweep(rows, cuts):
    """Ranges swept apart and matched by rank give the matches of one sweep over everything."""
    rows = sorted(rows)
    kinds = [k for _, k in rows]
    bounds = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    found, left, counts = [], {}, []
    for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
        own = packing.match(kinds[a:b])
        found += [(a + x, a + y) for x, y in own]
        taken = {k for pair in own for k in pair}
        for kind in (0, 1):
            left[part, kind] = [a + k for k in range(b - a) if kinds[a + k] == kind and k not in taken]
        counts.append((part, len(left[part, 0]), len(left[part, 1])))
    numbers = []
    for number, n, pieces, last, gaps, first in packing.across(counts):
        numbers += range(number, number + n)
        found += [(left[pieces, 0][last - k], left[gaps, 1][first + k]) for k in range(n)]
    assert sorted(found) == sorted(packing.match(kinds)) and numbers == list(range(len(numbers)))
    # best fit: a gap's piece fits, and the most gaps that can be filled with one piece each are filled
    assert all(rows[x][0] <= rows[y][0] for x, y in found)
    free, most = 0, 0
    for _, kind in rows:
        free += not kind
        if kind and free:
            free, most = free - 1, most + 1
    assert len(found) == most


def check_lengths(spark, rows, capacity, slack):
    """rows: (doc_id, piece, length)."""
    table = spark.createDataFrame([(d, p, 0, n, 7) for d, p, n in rows], packing.PIECES)
    got = packing.pack(table, capacity).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in got) == sorted((str(d), p, n) for d, p, n in rows)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in held.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= -(-sum(n for *_, n in rows) // capacity) + slack


def test_packing_repeated_and_null_ids(spark):
    rng = np.random.default_rng(0)
    rows = [(None, 0, int(n)) for n in rng.integers(1, 40, 300)] + [(5, 0, 9)] * 200 + [(None, 0, 3)] * 100
    check_lengths(spark, rows, 64, 2)


def test_packing_of_one_length_and_of_large_pieces(spark):
    check_lengths(spark, [(k, 0, 1) for k in range(3000)], 64, 1)
    check_lengths(spark, [(k, 0, 40) for k in range(50)] + [(100, 0, 1)], 64, 50 - 32)
    check_lengths(spark, [(k, k % 3, 64) for k in range(20)], 64, 0)


def check_codes(docs):
    want = expected_tokens(docs, FILES[1], 1)
    rows = {r["doc_id"]: r for r in huffman.coded(docs).collect()}
    assert set(rows) == set(want)
    at = 0
    for doc in sorted(want):
        r = rows[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want[doc]), crc(want[doc]))
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[doc]
        at += len(want[doc])


def test_codes_of_documents(spark, sf):
    check_codes(load(spark, sf, "documents"))


def test_codes_of_odd_documents(odd_docs, no_docs):
    check_codes(odd_docs)
    assert huffman.coded(no_docs).count() == 0


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16))
@settings(max_examples=60, deadline=None)
def test_code_lengths_are_complete_and_limited(counts, limit):
    lengths = huffman.code_lengths(np.array(counts, np.int64), limit)
    used = [n for n, c in zip(lengths.tolist(), counts) if c]
    assert all(1 <= n <= limit for n in used) and all(not n for n, c in zip(lengths.tolist(), counts) if not c)
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1


def test_code_lengths_are_optimal_where_the_limit_is_loose():
    import heapq

    counts = np.array([50, 20, 11, 7, 5, 3, 2, 1, 1], np.int64)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost


@given(st.lists(st.integers(0, 400), max_size=700))
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(ids):
    ids = np.array(ids, np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1) if len(ids) else np.array([1]))
    bits, marks = huffman.pack_bits(ids, huffman.canonical(lengths), lengths)
    assert huffman.Table(lengths).decode(bits, marks, len(ids)).tolist() == ids.tolist()
