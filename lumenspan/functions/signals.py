"""How machine-made a text sounds: six weighted layers, gated rewrites (X19, X20), in built-in functions alone.

Defined cases: null and blank texts score 0 in every layer and are human; texts of any length are read whole; rows keep
their columns, new ones begin with an underscore until they are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.text import spread, wide_sentences

# Results depend on exactly these.
CLICHES = (
    "值得注意的是", "需要指出的是", "综上所述", "总而言之", "由此可见", "显而易见", "众所周知", "毋庸置疑", "不可否认", "与此同时", "在当今社会", "随着时代的发展", "在这个背景下", "总的来说", "换言之",
    "简而言之", "具体而言", "深入来看", "从本质上来说", "前所未有的", "广泛的应用前景", "重要的理论意义", "it is worth noting", "it should be noted that", "in conclusion", "in summary", "furthermore",
    "moreover", "additionally", "in today's world", "with the development of", "as we all know", "plays a crucial role", "plays an important role", "has emerged as", "has gained significant attention",
    "a growing body of evidence", "in the realm of", "it is imperative to", "delve into", "navigate the complexities", "landscape", "tapestry", "myriad", "underscores", "highlights the importance",
    "paves the way", "sheds light on", "in the ever-evolving", "cutting-edge", "revolutionize", "transform", "empower", "leverage", "seamlessly", "robust", "comprehensive", "holistic",
)
CLICHE_PATTERNS = (r"在当今.{0,14}?(背景|时代|形势)下", r"随着.{0,12}?(发展|进步|推进)", r"不仅.{1,20}?(而且|并且|还|也)", r"一方面.{1,25}?另一方面", r"未来的?发展(趋势|方向|前景)")
EMPTY_WORDS = (
    "赋能", "抓手", "闭环", "生态", "矩阵", "心智", "颗粒度", "底层逻辑", "顶层设计", "组合拳", "发力", "聚力", "蓄势", "unlock", "unleash", "harness", "foster", "facilitate", "enhance", "optimize", "streamline", "revolutionize",
)
SUBLIMATION = (r"不仅是.{2,10}更是.{2,15}", r"不是.{2,10}而是.{2,15}", r"让我们一起", r"在.{2,10}的道路上", r"唯有.{2,10}方能.{2,15}", r"这不仅是.{2,10}更是.{2,15}")
MECHANICAL = r"^([第一二三四五六七八九十]+[，、。]|[0-9]+[.、）)])"
THREE_STEPS = r"(?s)首先.{20,}其次.{20,}最后"
FLAT = ("很好", "不错", "优秀", "出色", "卓越", "显著", "积极", "good", "great", "excellent", "outstanding", "remarkable", "significant", "positive", "effective", "successful")
SMOOTH = ("因此", "所以", "于是", "从而", "进而", "由此", "therefore", "thus", "hence", "consequently", "as a result")
JUDGING = ("是", "不是", "应该", "不能", "证明", "表明", "说明", "发现", "认为", "建议", "需要", "必须", "is", "should", "must", "proves", "suggests", "argues", "claims")
CONNECTORS = ("however", "therefore", "moreover", "furthermore", "additionally", "然而", "因此", "此外", "另外", "同时")
PRAISE, FACTS = "重要|关键|核心|意义|价值", "[0-9]|%|实验|数据|结果"
NUMBER, PROPER, HEDGE = r"[0-9]+(?:\.[0-9]+)?%?", r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)*", "可能|也许|似乎|大概|某种程度上|在一定程度上|potentially|possibly|may|might"
KNOWING, UPLIFT = "众所周知|毋庸置疑|毫无疑问|显然|当然|certainly|obviously|undoubtedly", "让我们|展望未来|光明|未来可期|美好|in the future|look forward"
TROUBLE = "困难|挑战|问题|局限|失败|不足|problem|challenge|limitation|fail"
LAYERS = (("opinion", 15), ("structure", 25), ("expression", 30), ("material", 10), ("narrative", 10), ("emotion", 10))
MILD, HEAVY, GATE = 25, 55, 30
REPLACED = (
    ("值得注意的是", ""), ("需要指出的是", ""), ("综上所述", "综上"), ("总而言之", ""), ("由此可见", "可见"), ("显而易见", ""), ("众所周知", ""), ("毋庸置疑", ""), ("不可否认", ""), ("与此同时", "同时"), ("在当今社会", "现在"),
    ("随着时代的发展", "近年来"), ("在这个背景下", "在此背景下"), ("具体而言", "具体来说"), ("从本质上来说", "本质上"), ("it is worth noting that", ""), ("it should be noted that", ""), ("in conclusion", ""), ("in summary", ""),
    ("furthermore", "also"), ("moreover", "also"), ("additionally", "also"), ("plays a crucial role in", "matters for"), ("plays an important role in", "matters for"), ("in the realm of", "in"), ("it is imperative to", "we must"), ("a growing body of evidence", "studies"),
)
VAGUE, FIGURES, ASK_FOR_DATA = "重要|显著|大幅|明显", "[0-9]|%", "（需补充具体数据）。"
# End of fixed values.


def _times(text: Column, words: tuple[str, ...]) -> Column:
    """How often the words occur in all, each counted apart."""
    return reduce(lambda a, b: a + b, [(F.length(text) - F.length(F.replace(text, F.lit(w)))) / len(w) for w in words])


def _some(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _points(*rules: tuple[Column, int]) -> Column:
    return F.least(F.lit(100), reduce(lambda a, b: a + b, [F.when(cond, n).otherwise(0) for cond, n in rules]))


def scored(rows: DataFrame, text: str = "text", out: str = "signal") -> DataFrame:
    """Rows with a struct (opinion, structure, expression, material, narrative, emotion, score, verdict): 0 to 100, lower is more like people.

    What several rules need (sentences, lines, their numbers) is made once, in columns of its own.
    """
    kept = rows.columns
    t = F.coalesce(F.col(text), F.lit(""))
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    rows = rows.withColumns({"_t": t, "_low": F.lower(t), "_s": wide_sentences(t), "_lines": F.filter(F.transform(F.split(t, "\n"), strip), lambda s: s != "")})
    rows = rows.withColumns({"_n": F.size("_s"), "_lows": F.transform("_s", lambda s: F.lower(s)), "_sizes": F.transform("_lines", lambda s: F.length(s))})
    # the patterns of clichés have no letters of two cases, so lower-case sentences serve both
    has = lambda c: reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in CLICHES])
    rows = rows.withColumns({"_cliches": has(F.col("_low")), "_patterns": reduce(lambda a, b: a + b, [F.col("_t").rlike(p).cast("int") for p in CLICHE_PATTERNS])})
    asked = (F.col("_cliches") > 0) | reduce(lambda a, b: a | b, [F.col("_low").rlike(p) for p in CLICHE_PATTERNS])  # else no sentence has any
    templated = lambda s: _some(s, CLICHES) | reduce(lambda a, b: a | b, [s.rlike(p) for p in CLICHE_PATTERNS])
    rows = rows.withColumns({
        "_judging": F.size(F.filter("_s", lambda s: _some(s, JUDGING))), "_templated": F.when(asked, F.size(F.filter("_lows", templated))).otherwise(0), "_marks": F.size(F.filter("_lines", lambda s: s.rlike(MECHANICAL))), "_spread": spread(F.col("_sizes")),
    })
    text, low, n = F.col("_t"), F.col("_low"), F.col("_n")
    share = lambda k: F.when(n > 0, k / n).otherwise(0.0)
    of = lambda pattern, where: F.size(F.regexp_extract_all(where, F.lit(pattern), F.lit(0)))
    found = F.col("_cliches") + F.col("_patterns")
    empty = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in EMPTY_WORDS])
    dense = share(F.col("_templated"))
    layers = {
        "opinion": _points(((n > 3) & (share(F.col("_judging")) < 0.2), 40), ((n > 0) & text.rlike(PRAISE) & ~text.rlike(FACTS), 20)),
        "structure": _points(((F.size("_lines") >= 3) & (F.col("_spread") < 0.2), 30), (F.col("_marks") >= 3, 25), (text.rlike(THREE_STEPS), 20)),
        "expression": F.least(F.lit(100), 8 * found + 5 * empty + _points(
            (share(_times(low, CONNECTORS)) > 0.3, 20), ((n >= 2) & (dense >= 0.5), 35), ((n >= 2) & (dense >= 0.25) & (dense < 0.5), 15), (reduce(lambda a, b: a | b, [text.rlike(p) for p in SUBLIMATION]), 15))),
        "material": _points(((F.length(text) > 200) & (of(NUMBER, text) < 2) & (of(PROPER, text) < 3), 35), (of(HEDGE, text) > 3, 15)),
        "narrative": _points((share(_times(low, SMOOTH)) > 0.2, 25), (low.rlike(KNOWING), 20)),
        "emotion": _points((low.rlike(UPLIFT), 30), ((_times(low, FLAT) > 3) & (of(TROUBLE, low) == 0), 20)),
    }
    rows = rows.withColumns({f"_{k}": F.when(text.rlike(r"\S"), v).otherwise(0).cast("int") for k, v in layers.items()})
    rows = rows.withColumn("_score", F.bround(reduce(lambda a, b: a + b, [w * F.col(f"_{k}") for k, w in LAYERS]) / 100.0).cast("int"))
    verdict = F.when(F.col("_score") < MILD, "human").when(F.col("_score") < HEAVY, "mild_ai").otherwise("heavy_ai")
    return rows.select(*kept, F.struct(*(F.col(f"_{k}").alias(k) for k, _ in LAYERS), F.col("_score").alias("score"), verdict.alias("verdict")).alias(out))


def gated(rows: DataFrame, text: str = "text", most: int = GATE) -> DataFrame:
    """Rows with `passes`: may the text go out, is its score below the gate?"""
    return scored(rows, text, "_signal").withColumn("passes", F.col("_signal.score") < most).drop("_signal")


def rewritten(text: Column, strength: str = "light") -> Column:
    """A text with its clichés replaced (light), list marks evened and vague sentences marked (medium), long sentences cut and lofty phrases dropped (heavy).

    medium and heavy join the sentences without the marks between them, as their rule says. Blank texts stay as they are.
    """
    if strength not in ("light", "medium", "heavy"):
        raise ValueError(f"strength {strength!r}")
    out = text
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(F.regexp_replace(out, " {2,}", " "), r"\n{3,}", "\n\n")
    if strength != "light":
        listed = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
        out = F.array_join(F.transform(F.split(out, "\n"), lambda s: F.when(listed(s).rlike("^[0-9]+[.、]"), F.regexp_replace(listed(s), r"^([0-9]+)[.、]\s*", "$1. ")).otherwise(s)), "\n")
        vague = lambda s: s.rlike(VAGUE) & ~s.rlike(FIGURES)
        out = F.array_join(F.transform(wide_sentences(out), lambda s: F.when(vague(s), F.concat(F.regexp_replace(s, "[。.]+$", ""), F.lit(ASK_FOR_DATA))).otherwise(s)), "")
    if strength == "heavy":
        parts = lambda s: F.split(s, "，", -1)
        cut = lambda s: F.concat(F.array_join(F.slice(parts(s), 1, 2), "，"), F.lit("。"), F.array_join(F.slice(parts(s), 3, 1 << 30), "，"))
        out = F.array_join(F.transform(wide_sentences(out), lambda s: F.when((F.length(s) > 60) & (F.size(parts(s)) > 2), cut(s)).otherwise(s)), "")
        for pattern in SUBLIMATION:
            out = F.regexp_replace(out, pattern, "")
    return F.when(text.rlike(r"\S"), F.regexp_replace(out, r"^\s+|\s+$", "")).otherwise(text)
