"""N-best segmentation against all paths of the lattice, and exact decoding."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.llm import nbest
from lumenspan.llm.tokens import tokenizer_path
from lumenspan.session import load


@pytest.fixture(scope="module")
def pieces():
    return nbest.model(tokenizer_path("piece_bpe_32k.model"))


def all_paths(pieces, text):
    """Scores of every segmentation of the whole text, by plain recursion over the piece table."""
    text = nbest.SPACE + text.replace(" ", nbest.SPACE) if text else ""
    memo = {len(text): [(0.0, ())]}
    for i in range(len(text) - 1, -1, -1):
        arcs = [(j, *pieces.pieces[text[i:j]]) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces.pieces]
        if not any(j == i + 1 for j, _, _ in arcs):
            raw = text[i].encode()
            arcs.append((i + 1, nbest.BYTE_SCORE * len(raw), tuple(pieces.byte_ids[b] for b in raw)))
        memo[i] = [(s + score, (*ids, *rest)) for j, score, ids in arcs for s, rest in memo[j]]
    return memo[0]


@given(st.text(st.sampled_from("the an\nçé🙂 \x00"), max_size=9), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_best_paths(text, n):
    pieces = nbest.model(tokenizer_path("piece_bpe_32k.model"))
    want = sorted(all_paths(pieces, text), key=lambda x: -x[0])
    scores, ids = nbest.encode_batch(pieces, pa.array([text]), n)
    assert scores[0] == pytest.approx([s for s, _ in want[:n]])
    table = {}
    for s, path in want:
        table.setdefault(path, s)
    got = [tuple(x.tolist()) for x in ids[0]]
    assert len(set(got)) == len(got)
    assert [table[g] for g in got] == pytest.approx(scores[0])
    assert all(pieces.decode(np.array(g, np.int64)).decode() == text for g in got)


def test_batches_equal_single_texts(spark, sf, pieces):
    texts = [r["text"] for r in load(spark, sf, "documents").limit(40).collect()]
    many = nbest.encode_batch(pieces, pa.array(texts), 4)
    for k, text in enumerate(texts):
        scores, ids = nbest.encode_batch(pieces, pa.array([text]), 4)
        assert scores[0] == pytest.approx(many[0][k])
        parts = nbest.segments(pa.array([text]))[0].as_py()
        whole = nbest.joined([pieces.lattice(s) for s in parts if s])  # A* over the whole lattice, no segment kept
        assert [s for s, _ in whole.search(4)] == pytest.approx(scores[0])
        assert all(pieces.decode(x).decode() == text for x in many[1][k])


def test_documents_decode(spark, sf, odd_docs, no_docs):
    import zlib

    model = nbest.model(tokenizer_path("piece_bpe_32k.model"))
    for docs in (load(spark, sf, "documents"), odd_docs):
        texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
        got = nbest.digests(docs).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r["all_decode"] and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
            assert r["scores"] == sorted(r["scores"], reverse=True) and len(set(r["ids_crc32"])) == len(r["scores"])
        whole = {r["doc_id"]: r for r in nbest.segmentations(docs).collect()}
        for r in got:
            own = whole[r["doc_id"]]
            assert own["scores"] == r["scores"] and [zlib.crc32(bytes(x)) for x in own["ids"]] == r["ids_crc32"]
            decoded = {model.decode(np.frombuffer(bytes(x), "<u4")) for x in own["ids"]}
            assert decoded == {texts[r["doc_id"]].encode()}
    assert nbest.digests(no_docs).count() == 0
    assert nbest.segmentations(no_docs).count() == 0
