"""Human-text signal and rewrites against plain Python."""

import random
import re
from statistics import pstdev

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import signals as G


def score(text):
    text = text or ""
    if not text.strip():
        return (0, 0, 0, 0, 0, 0, 0, "human")
    low = text.lower()
    sentences = [s.strip() for s in re.split(r"[。！？!?\n]+", text) if s.strip()]
    n = len(sentences) or 1
    lines = [s.strip() for s in text.split("\n") if s.strip()]
    cliche = lambda s: any(c in s.lower() for c in G.CLICHES) or any(re.search(p, s) for p in G.CLICHE_PATTERNS)
    times = lambda words: sum(low.count(w) for w in words)
    opinion = 40 * (len(sentences) > 3 and sum(any(m in s for m in G.JUDGING) for s in sentences) / n < 0.2) + 20 * bool(sentences and re.search(G.PRAISE, text) and not re.search(G.FACTS, text))
    sizes = [len(x) for x in lines]
    structure = 30 * (len(lines) >= 3 and pstdev(sizes) / (sum(sizes) / len(sizes)) < 0.2) + 25 * (sum(bool(re.match(G.MECHANICAL, x)) for x in lines) >= 3) + 20 * bool(re.search(r"首先.{20,}其次.{20,}最后", text, re.S))
    dense = sum(map(cliche, sentences)) / n if len(sentences) > 1 else 0
    expression = 8 * (sum(c in low for c in G.CLICHES) + sum(bool(re.search(p, text)) for p in G.CLICHE_PATTERNS)) + 5 * sum(w in low for w in G.EMPTY_WORDS)
    expression += 20 * bool(sentences and times(G.CONNECTORS) / n > 0.3) + (35 if dense >= 0.5 else 15 if dense >= 0.25 else 0) + 15 * any(re.search(p, text) for p in G.SUBLIMATION)
    material = 35 * (len(text) > 200 and len(re.findall(r"\d+(?:\.\d+)?%?", text)) < 2 and len(re.findall(G.PROPER, text)) < 3) + 15 * (len(re.findall(G.HEDGE, text)) > 3)
    narrative = 25 * bool(sentences and times(G.SMOOTH) / n > 0.2) + 20 * bool(re.search(G.KNOWING, low))
    emotion = 30 * bool(re.search(G.UPLIFT, low)) + 20 * (times(G.FLAT) > 3 and not re.search(G.TROUBLE, low))
    layers = [min(100, x) for x in (opinion, structure, expression, material, narrative, emotion)]
    total = round(sum(w * x for (_, w), x in zip(G.LAYERS, layers)) / 100)
    return (*layers, total, "human" if total < 25 else "mild_ai" if total < 55 else "heavy_ai")


PIECES = (
    "值得注意的是，", "随着技术的发展，", "不仅快而且好。", "一方面好，另一方面坏。", "赋能", "重要", "实验", "It is robust. ", "Furthermore, ", "therefore ", "Hence! ", "1. a\n", "2、b\n", "三、c\n", "good ", "great ", "excellent ", "positive ", "problem ",
    "In the future ", "Graph Net ", "3.5% ", "may ", "might ", "可能", "似乎", "不是这个而是那个东西", "首先" + "甲" * 25, "其次" + "乙" * 25, "最后。", "显然", "结论是", "\n", "！", "plain words here ", "x" * 90 + " ", "However ",
)


def test_layers_equal_plain_python(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", " \n ", "。", "word"]
    heavy = "。".join(G.CLICHES) + "首先" + "甲" * 25 + "其次" + "乙" * 25 + "最后。重要，因此所以于是，未来可期" + "因此" * 30
    texts.append("\n".join("一、" + heavy[k : k + 40] for k in range(0, len(heavy) - 40, 40)))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").withColumn("score", F.lit("kept"))
    got = {r["k"]: tuple(r["signal"]) for r in G.scored(rows).collect()}
    assert got == {k: score(t) for k, t in enumerate(texts)}
    assert len({g[6] for g in got.values()}) > 20 and {g[7] for g in got.values()} == {"human", "mild_ai", "heavy_ai"}
    assert G.scored(rows).columns == ["k", "text", "score", "signal"] and G.scored(rows.limit(0)).count() == 0
    assert {r["k"] for r in G.gated(rows).where("passes").collect()} == {k for k, g in got.items() if g[6] < 30}


def plain_rewrite(text, strength):
    if not text or not text.strip():
        return text
    for old, new in G.REPLACED:
        text = text.replace(old, new)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(" {2,}", " ", text))
    parts = lambda t: [s.strip() for s in re.split(r"[。！？!?\n]+", t) if s.strip()]
    if strength != "light":
        text = "\n".join(re.sub(r"^(\d+)[.、]\s*", r"\1. ", x.strip()) if re.match(r"^\d+[.、]\s*", x.strip()) else x for x in text.split("\n"))
        text = "".join(s.rstrip("。.") + G.ASK_FOR_DATA if re.search(G.VAGUE, s) and not re.search(r"\d|%", s) else s for s in parts(text))
    if strength == "heavy":
        out = []
        for s in parts(text):
            some = s.split("，")
            out += ["，".join(some[:2]) + "。", "，".join(some[2:])] if len(s) > 60 and len(some) > 2 else [s]
        text = "".join(out)
        for p in G.SUBLIMATION:
            text = re.sub(p, "", text)
    return text.strip()


def test_rewrites_equal_plain_python(spark):
    rng = random.Random(3)
    pool = (*PIECES, "，", "，这是一个很长的句子用来测试拆分", "综上所述，", "in conclusion", "moreover", "  ", "\n\n\n", "显著提升", "不仅是甲乙更是丙丁")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(200)] + [None, "", "  ", "值得注意的是"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    for strength in ("light", "medium", "heavy"):
        got = {r["k"]: r["x"] for r in rows.select("k", G.rewritten(F.col("t"), strength).alias("x")).collect()}
        assert got == {k: plain_rewrite(t, strength) for k, t in enumerate(texts)}
    with pytest.raises(ValueError):
        G.rewritten(F.col("t"), "other")


def test_sentences_are_searched_only_in_texts_with_a_cliche(spark):
    """every sentence was searched for every cliché, though its text had none."""
    texts = ["Robust plan.! A TAPESTRY! no", "one! two! three", "不仅 a 而且 b! x", "in! conclusion! x", ""]
    rows = G.scored(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"))
    assert "CASE WHEN ((_cliches" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r["signal"]["expression"] for r in rows.orderBy("k").collect()] == [16 + 35, 0, 8 + 35, 0, 0]
