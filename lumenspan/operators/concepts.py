"""Concept merge: components over three levels of keys and over definitions, and what an acronym stands for.

Defined cases: blank names and keys join nothing; null types and aliases are none; repeated definitions count once;
an empty table gives no rows; extra columns are ignored. Concepts that share a key are linked to the smallest of them and
full names are compared in blocks, so neither a common key nor an acronym with many names is ever paired in full.
"""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import singular
from lumenspan.operators.components import connected_components
from lumenspan.operators.rules import concept_keys
from lumenspan.session import ship, stored

# Results depend on exactly these.
WORD_JACCARD, CHAR_RATIO = 0.5, 0.85
LEADING_PARTICIPLES = ("preceding", "following", "using", "while", "including", "considering", "according", "given", "based")
LEVELS = ("case", "hyphen_space", "plural")
# End of fixed values.

#: Ours: words that begin no full name; a caller's longer list takes their place.
FUNCTION_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "than", "that", "the", "this", "to", "was", "were", "which", "while", "with")


def fragment(full: str, acronym: str, function_words: Iterable[str] = FUNCTION_WORDS) -> str:
    """X17, on keys: empty, acronym_repeated, repeated_phrase, leading_function_word, leading_participle, or '' for a whole name."""
    words, short = full.split(), acronym.split()
    if not words:
        return "empty"
    n, at = 0, 0
    while short and at <= len(words) - len(short):
        met = words[at : at + len(short)] == short
        n, at = n + met, at + (len(short) if met else 1)
    if n >= 2:
        return "acronym_repeated"
    for size in range(2, len(words) // 2 + 1):
        runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        if len(set(runs)) < len(runs):
            return "repeated_phrase"
    if words[0] in function_words:
        return "leading_function_word"
    return "leading_participle" if words[0] in LEADING_PARTICIPLES else ""


def equivalence(left: str, right: str) -> str:
    """X18, on keys: substring, word_jaccard, char_similarity or ''."""
    if not left or not right:
        return ""
    if left in right or right in left:
        return "substring"
    a, b = set(left.split()), set(right.split())
    if len(a & b) >= WORD_JACCARD * len(a | b):
        return "word_jaccard"
    return "char_similarity" if SequenceMatcher(None, left, right).ratio() >= CHAR_RATIO else ""


def plural_key(name: str) -> Column:
    return concept_keys(F.col(name), singular)["plural_key"]


def _grams(size: int) -> Column:
    """Runs of `size` characters of f, each with how often it came before, so that equal ones differ."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("f") - size + 1)), lambda i: F.substring("f", i, size))
    return F.transform(runs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(runs, F.lit(1), i), lambda h: h == g)).cast("string")))


def _prefixes(names: DataFrame, items: Column, needed: Column) -> DataFrame:
    """(k, f, item): of each name's items the rarest, so many that names with `needed` items in common share one of them."""
    rows = names.withColumn("needed", needed).withColumn("items", items).select("k", "f", "needed", F.size("items").alias("size"), F.explode("items").alias("item"))
    counts = rows.groupBy("k", "item").agg(F.count("*").alias("n"))
    order = Window.partitionBy("k", "f").orderBy("n", "item")  # one name's items
    rows = rows.join(counts, ["k", "item"]).withColumn("r", F.row_number().over(order))
    return rows.where(F.col("r") <= F.col("size") - F.greatest(F.lit(1), F.col("needed")) + 1).select("k", "f", "item")


def candidate_pairs(names: DataFrame) -> DataFrame:
    """(k, a, b), a < b: names(k, f) of one acronym that can be equivalent; none that are can be missing.

    Half of the words in common: prefixes of the rarest words. One inside the other: the inner's rarest run of three
    characters is in the outer (shorter ones as a whole). A ratio of .85 over S characters in all leaves at least
    .275 S - 1 runs of two characters in common (each unmatched character splits a match once): prefixes again.
    """
    size = F.length("f")
    words = F.array_distinct(F.split("f", " "))
    by_words = _prefixes(names, words, F.ceil(F.size(words) * WORD_JACCARD))
    shortest = F.ceil(size * CHAR_RATIO / (2 - CHAR_RATIO) - 1e-9)
    by_runs = _prefixes(names.where(size > 1), _grams(2), F.ceil((1.5 * CHAR_RATIO - 1) * (size + shortest) - 1 - 1e-9))
    alike = [side.select("k", F.col("f").alias("a"), "item").join(side.select("k", F.col("f").alias("b"), "item"), ["k", "item"]).where("a < b").select("k", "a", "b") for side in (by_words, by_runs)]
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    alike[1] = alike[1].where(short >= long * CHAR_RATIO / (2 - CHAR_RATIO) - 1e-9)
    bare = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.substring("f", i, n)))
    inner = _prefixes(names.where(size >= 3), bare(3), F.size(bare(3))).unionByName(names.where(size < 3).select("k", "f", F.col("f").alias("item")))
    outer = names.select("k", F.col("f").alias("g"), F.explode(F.array_distinct(F.concat(bare(1), bare(2), bare(3)))).alias("item"))
    inside = inner.join(outer, ["k", "item"]).where("length(g) > length(f) AND contains(g, f)").select("k", F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b"))
    return alike[0].unionByName(alike[1]).unionByName(inside).distinct()


def definitions_judged(definitions: DataFrame, function_words: Iterable[str] = FUNCTION_WORDS) -> DataFrame:
    """definitions(acronym, full_name) to (k, n_names, n_kept, n_components, verdict), k the acronym's key.

    Fragments go first; what is left is grouped by equivalence. Several groups: ambiguous. One group of several names, or
    one name left of several: rescued. Otherwise plain.
    """
    ship(definitions.sparkSession)
    stop = frozenset(function_words)

    @F.pandas_udf("string")
    def reason(full: pd.Series, acronym: pd.Series) -> pd.Series:
        return pd.Series([fragment(f or "", a or "", stop) for f, a in zip(full, acronym)], dtype=object)

    @F.pandas_udf("string")
    def rule(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([equivalence(a, b) for a, b in zip(left, right)], dtype=object)

    rows = definitions.select(plural_key("acronym").alias("k"), plural_key("full_name").alias("f")).where("k <> ''").distinct()
    rows = stored(rows.withColumn("reason", reason("f", "k")), "full_names")
    kept = rows.where("reason = ''").select("k", "f")
    node = lambda f: F.concat("k", F.lit("\x1f"), f)
    links = candidate_pairs(kept).withColumn("rule", rule("a", "b")).where("rule <> ''").select(node("a").alias("src"), node("b").alias("dst"))
    found = connected_components(links)
    groups = kept.withColumn("node", node("f")).join(found, "node", "left").groupBy("k").agg(F.count("*").alias("n_kept"), F.countDistinct(F.coalesce("component", "node")).alias("n_components"))
    out = rows.groupBy("k").agg(F.count(F.when(F.col("f") != "", 1)).alias("n_names"), F.count(F.when(F.col("reason") != "", 1)).alias("n_fragments")).join(groups, "k", "left").na.fill(0, ["n_kept", "n_components"])
    rescued = (F.col("n_kept") > 1) | (F.col("n_fragments") > 0) & (F.col("n_names") > 1)
    return out.select("k", "n_names", "n_kept", "n_components", F.when(F.col("n_components") > 1, "ambiguous").when(rescued, "rescued").otherwise("plain").alias("verdict"))


def merged(concepts: DataFrame, definitions: DataFrame, definition_decides: bool = True, function_words: Iterable[str] = FUNCTION_WORDS) -> DataFrame:
    """concepts(concept_id, canonical, aliases, type) and definitions(acronym, full_name) to a row for each concept.

    Concepts that share a key of any level, and the two sides of a definition, are one component. It is `ambiguous` if one of
    its acronyms is, a `type_conflict` if it has several types and no definition (or definitions don't decide), else
    `merged`: under the longest canonical name (then the smallest id), with the type of the longest full name of its
    definitions, else of that name. Only merged components share a group_id, canonical and type. basis lists what links
    it: definition_pair, case, hyphen_space, plural.
    """
    rows = concepts.select("concept_id", F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("type", F.lit("")).alias("type"))
    rows = stored(rows, "concepts")
    forms = rows.select("concept_id", F.explode(F.concat(F.array("canonical"), "aliases")).alias("form"))
    forms = stored(forms.withColumn("key", concept_keys(F.col("form"), singular)).select("concept_id", F.col("key.case_key").alias("case"), F.col("key.separator_key").alias("hyphen_space"), F.col("key.plural_key").alias("plural")).distinct(), "forms")
    ends = forms.where("plural <> ''").groupBy("plural").agg(F.min("concept_id").alias("low"), F.max("concept_id").alias("high"))
    by_key = forms.join(ends, "plural").where("concept_id <> low").select(F.col("concept_id").alias("src"), F.col("low").alias("dst"))
    side = lambda k: ends.select(F.col("plural").alias(k), F.col("low").alias(f"{k}_low"), F.col("high").alias(f"{k}_high"))
    defined = definitions.select(plural_key("acronym").alias("k"), plural_key("full_name").alias("f")).distinct().join(side("k"), "k").join(side("f"), "f")
    defined = stored(defined.where("NOT (k_low = k_high AND f_low = f_high AND k_low = f_low)"), "definitions")  # a concept doesn't define itself
    found = connected_components(by_key.unionByName(defined.select(F.col("k_low").alias("src"), F.col("f_low").alias("dst"))))
    rows = stored(rows.join(found.withColumnRenamed("node", "concept_id"), "concept_id", "left").withColumn("component", F.coalesce("component", "concept_id")), "components")
    place = rows.select("concept_id", "component")

    within = defined.join(place.withColumnRenamed("concept_id", "k_low"), "k_low").join(definitions_judged(definitions, function_words).select("k", "verdict"), "k", "left")
    flags = within.groupBy("component").agg(F.bool_or(F.col("verdict") == "ambiguous").alias("ambiguous"))
    full = within.select("component", "k_low", "k_high", F.col("f").alias("plural")).join(forms.select("plural", "concept_id"), "plural").where("NOT (k_low = k_high AND k_low = concept_id)")
    full = full.join(rows.select("concept_id", "canonical", "type"), "concept_id").groupBy("component").agg(F.min_by("type", F.struct(-F.length("canonical"), "concept_id")).alias("full_type"))
    levels = None
    for level in LEVELS:
        shared = forms.where(F.col(level) != "").groupBy(level).agg(F.min("concept_id").alias("concept_id"), F.max("concept_id").alias("_h")).where("concept_id <> _h")
        shared = shared.join(place, "concept_id").select("component", F.lit(level).alias("level")).distinct()
        levels = shared if levels is None else levels.unionByName(shared)
    levels = levels.groupBy("component").agg(F.collect_set("level").alias("levels"))  # three at most

    order = F.struct(-F.length("canonical"), "concept_id")
    groups = rows.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("type") != "", F.col("type"))).alias("n_types"), F.min(F.when(F.col("type") != "", F.col("type"))).alias("first_type"), F.min_by("canonical", order).alias("best"), F.min_by("type", order).alias("best_type"))
    groups = groups.join(flags, "component", "left").join(full, "component", "left").join(levels, "component", "left")
    decided = F.col("ambiguous").isNotNull() & F.lit(definition_decides)
    verdict = F.when(F.col("n") == 1, "single").when(F.coalesce("ambiguous", F.lit(False)), "ambiguous").when((F.col("n_types") > 1) & ~decided, "type_conflict").otherwise("merged")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    kind = F.coalesce(F.when(decided, given("full_type")), given("best_type"), "first_type", F.lit(""))
    basis = F.array_compact(F.array(F.when(F.col("ambiguous").isNotNull(), "definition_pair"), *(F.when(F.coalesce(F.array_contains("levels", level), F.lit(False)), level) for level in LEVELS)))
    groups = groups.select("component", verdict.alias("verdict"), "best", kind.alias("kind"), "n_types", basis.alias("basis"))
    one = F.col("verdict") == "merged"
    return rows.join(groups, "component").select(
        "concept_id", F.when(one, F.col("component")).otherwise(F.col("concept_id")).alias("group_id"), F.when(one, F.col("best")).otherwise(F.col("canonical")).alias("canonical"),
        F.when(one, F.col("kind")).otherwise(F.col("type")).alias("type"), "verdict", (one & (F.col("n_types") > 1)).alias("type_resolved"), "basis",
    )
