"""Near copies against brute-force Jaccard over five-word shingles."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from lumenspan.llm import nearcopies  # noqa: E402
from lumenspan.session import load  # noqa: E402


def slow_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_heads(texts):
    """The smallest id of the component of every id."""
    sets, root = {i: slow_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def varied():
    """Originals with copies at likeness from 1 to 0.6, chains, a large group and shared boilerplate."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    legal = " ".join(word() for _ in range(60))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 60, 200]))]
        out.append(" ".join(base) + " " + legal)
        out.append(" ".join(base))
        for changes in (1, 1, 2, 3, 4, 6):
            text = list(base)
            for at in rng.sample(range(len(text)), changes):
                text[at] = word()
            out.append(" ".join(text))
    group = [word() for _ in range(150)]
    for k in range(40):
        text = list(group)
        text[3 * k] = word()
        out.append(" ".join(text))
    out += [legal, legal + " " + word(), "", None, " ", "one two", "One  Two", "one three"]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("sample", [1, 20000])
def test_every_pair_at_0_8(spark, sample, monkeypatch):
    monkeypatch.setattr(nearcopies, "SAMPLE_ROWS", sample)
    texts = varied()
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["key"]: r["component"] for r in nearcopies.near_copies(docs, "id").collect()}
    assert got == slow_heads(texts)


def test_stage(spark, sf, no_docs):
    """A word in 200 changed: fingerprints differ by more than three bits, and one document stays."""
    rng = random.Random(1)
    rows, columns = [], load(spark, sf, "documents").columns
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:100], "other", *words[101:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars")).select(*columns)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == list(range(0, 40, 2))
    docs = load(spark, sf, "documents")
    heads = slow_heads({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == sorted(set(heads.values()))


def test_stage_on_repeated_and_null_ids(spark, sf):
    """One row of each component stays, whatever its id."""
    columns = load(spark, sf, "documents").columns
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "another text of six words"), (None, "p q r s t u"), (None, "p q r s t u"), (None, "a b c d e f"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars")).select(*columns)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()))
    assert got == [(0, "alone"), (0, "p q r s t u"), (1, "a b c d e f"), (1, "another text of six words")]


def test_texts_are_sent_not_sets(spark, monkeypatch):
    """Pipeline, disk of near copies: whole sets of hashes were written and sent, three times the size of their texts."""
    words = [f"w{k}" for k in range(60)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-2], "x"]), 3: " ".join(words[:40]), 4: None, 5: " \n", 6: "a b", 7: "A  b"}
    docs = spark.createDataFrame([*texts.items()], "id long, text string")
    pairs = [(2, 1), (3, 1), (3, 2), (5, 4), (6, 4), (7, 6)]
    written, kept = [], nearcopies.stored
    monkeypatch.setattr(nearcopies, "stored", lambda frame, name: written.append(frame.dtypes) or kept(frame, name))
    got = sorted(tuple(r) for r in nearcopies.alike(spark.createDataFrame(pairs, "src long, dst long"), docs, "id").collect())
    sets = {k: set(nearcopies.shingle_set((t or "").encode()).tolist()) for k, t in texts.items()}
    assert got == sorted((a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])) and (2, 1) in got and (3, 1) not in got
    assert not any(kind.startswith("array") for table in written for _, kind in table)


def test_masks_are_a_bound(spark):
    """Pipeline, disk of near copies: no pair at 0.8 is lost by masks, folded or not, and unlike pairs go."""
    rng, sets = np.random.default_rng(3), {}
    for k in range(0, 120, 2):
        found = np.unique(rng.integers(0, 1 << 64, int(rng.integers(0, 700)), np.uint64))
        left = len(found) * int(rng.integers(0, 11)) // 10
        sets[k], sets[k + 1] = found, np.unique(np.append(found[:left], rng.integers(0, 1 << 64, len(found) // 12, np.uint64)))
    sets |= {200: np.zeros(0, np.uint64), 201: np.zeros(0, np.uint64)}
    masks = {k: nearcopies.mask(v) for k, v in sets.items()}
    assert len({len(m) for m in masks.values()}) > 3
    for a, b in [(k, k + 1) for k in sets if k % 2 == 0] + [(0, 9), (200, 3)]:
        assert nearcopies.apart(masks[a], masks[b]) == nearcopies.apart(masks[b], masks[a]) <= len(np.setxor1d(sets[a], sets[b]))
    classes = spark.createDataFrame([(k, len(v), bytearray(masks[k])) for k, v in sets.items()], "key long, size int, mask binary")
    pairs = [(b, a) for a in sets for b in sets if a < b]
    got = {tuple(r) for r in nearcopies.possible(spark.createDataFrame(pairs, "src long, dst long"), classes).collect()}
    shared = {(b, a): len(np.intersect1d(sets[a], sets[b])) for b, a in pairs}
    want = {(b, a) for b, a in pairs if 5 * shared[b, a] >= 4 * (len(sets[a]) + len(sets[b]) - shared[b, a])}
    assert want <= got and len(got) < len(want) + 20 and {(201, 200)} < want


def test_few_texts_are_sent(spark, monkeypatch):
    """Pipeline, disk of near copies: every candidate's texts were sent, chosen by a join of all texts, and all prefixes were dealt at once."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    legal = [rng.choice(words) for _ in range(60)]
    texts = {k: " ".join([*(rng.choice(words) for _ in range(40)), *legal]) for k in range(300)}
    texts |= {300 + k: f"{texts[k]} end" for k in range(20)}
    for k in range(100, 160):  # a likeness of 0.65: candidates by their prefixes
        changed = texts[k].split()
        changed[10::25] = ["other"] * 4
        texts[300 + k] = " ".join(changed)
    docs = spark.createDataFrame([*texts.items()], "id long, text string")
    sent, parts, compared, written = [], [], nearcopies.alike, nearcopies.stored
    monkeypatch.setattr(nearcopies, "alike", lambda pairs, *rest: sent.extend(tuple(r) for r in pairs.collect()) or compared(pairs, *rest))
    monkeypatch.setattr(nearcopies, "stored", lambda df, name="table": parts.append(name) or written(df, name))
    got = {r["key"]: r["component"] for r in nearcopies.near_copies(docs, "id").collect()}
    assert got == {k: k - 300 if 300 <= k < 320 else k for k in texts}
    assert {(300 + k, k) for k in range(20)} <= set(sent) and len(sent) < 40
    assert parts.count("lists") == nearcopies.PARTS
    ends = spark.createDataFrame([(k,) for k in range(0, 300, 30)], "id long")
    asked = {r["id"] for r in nearcopies._asked(docs, ends, "id").collect()}
    assert {*range(0, 300, 30)} <= asked and len(asked) < 15
