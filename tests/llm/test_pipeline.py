"""The pipeline's stages against brute force on small documents."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from lumenspan.llm import suffixes, toxicity  # noqa: E402
from lumenspan.session import load  # noqa: E402
from test_nearcopies import slow_heads  # noqa: E402
from test_suffixes import slow_covered  # noqa: E402
from test_tokens_packing_huffman import expected_tokens  # noqa: E402


def test_stages(spark, sf):
    docs = load(spark, sf, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf).cache())
    for df in steps[:-1]:
        assert df.columns == docs.columns
    first, clean, single, left, packed = (d.collect() for d in steps)
    model = toxicity.fit(docs, load(spark, sf, "labels"))
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in first if model.score(model.features(r["text"])) < 0.5}
    assert 0.8 * len(first) < len(clean) < len(first)
    assert sorted(r["doc_id"] for r in single) == sorted(set(slow_heads({r["doc_id"]: r["text"] for r in clean}).values()))
    rows = sorted((r["doc_id"], r["text"]) for r in single)
    got = {r["doc_id"]: r for r in left}
    for (doc, text), gone in zip(rows, slow_covered([t.encode() for _, t in rows])):
        raw, want, at = text.encode(), [], 0
        for c in text:
            n = len(c.encode())
            if not gone[at : at + n].all():
                want.append(c)
            at += n
        assert at == len(raw) and got[doc]["text"] == "".join(want) and got[doc]["n_chars"] == len(want)
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(t) for d, t in expected_tokens(steps[3], "byte_bpe_50k.json", 2).items()}
    assert len({r["sequence_id"] for r in packed}) <= -(-sum(lengths.values()) // 1024) + 2


def test_run_and_empty_tables(spark, sf, no_docs):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = no_docs.select(*load(spark, sf, "documents").columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_odd_documents(spark, sf, odd_docs):
    """Nulls in every column, repeated rows and ids, and extra columns whose names the operators use themselves."""
    extra = ["key", "block", "begin", "score", "component", "_row"]
    rows = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = rows.union(rows.where("doc_id > 3")).union(spark.createDataFrame([(None, None, None, None, None)] * 2 + [(None, "two of this and more words", None, None, None)] * 2, rows.schema))
    docs = rows.withColumns({c: F.lit(k) for k, c in enumerate(extra)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    left = docs.collect()
    assert len(left) == len({r["text"] for r in left})  # one row of each group of copies
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    want = expected_tokens(docs.withColumn("doc_id", F.monotonically_increasing_id()), "byte_bpe_50k.json", 2)
    assert sum(r["length"] for r in packed) == sum(map(len, want.values()))


def test_whole_characters():
    raw = "aéé🙂b".encode()
    assert suffixes.whole_characters(raw, [2], [6]) == "aé🙂b".encode()
    assert suffixes.whole_characters(raw, [1], [9]) == b"ab"
    assert np.array_equal(np.frombuffer(suffixes.whole_characters(raw, [], []), np.uint8), np.frombuffer(raw, np.uint8))
