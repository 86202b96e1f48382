"""Review, panel, generic mining and concept merging."""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import names_equivalent, normalized_name, split_sentences
from lumenspan.operators.components import connected_components
from lumenspan.session import ship


def direction_faults(relations: DataFrame, mentions: DataFrame, triggers: DataFrame) -> DataFrame:
    """Relations whose tail stands before a forward trigger and whose head stands after it, in some sentence.

    relations(relation_id, source, target, evidence_id), mentions(evidence_id, concept, char_start),
    triggers(evidence_id, at).
    """
    head = mentions.select("evidence_id", F.col("concept").alias("source"), F.col("char_start").alias("_h"))
    tail = mentions.select("evidence_id", F.col("concept").alias("target"), F.col("char_start").alias("_t"))
    rows = relations.join(head, ["evidence_id", "source"]).join(tail, ["evidence_id", "target"]).join(triggers, "evidence_id")
    return rows.where((F.col("_t") < F.col("at")) & (F.col("at") < F.col("_h"))).select("relation_id").distinct()


def mechanism_confidence(flags: list[Column], weights: tuple[float, ...] = (0.08, 0.10, 0.08, 0.04)) -> Column:
    """.80 less a weight for each flag, inside [.60, .99]."""
    out = F.lit(0.80)
    for flag, w in zip(flags, weights):
        out = out - F.when(flag, w).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.60), F.least(F.lit(0.99), out)), 6)


def live_claims(claims: DataFrame, allowed: DataFrame, most: int = 8) -> DataFrame:
    """claims(run_id, claim_no, ids, score): allowed ids alone, in order and once; confidence inside [0, .99]; under .5 or without ids rejected; the first `most`."""
    rows = claims.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("claim_no"))).where(F.col("_n") <= most).drop("_n")
    each = rows.select("run_id", "claim_no", F.posexplode(F.array_distinct("ids")).alias("_p", "id")).where("id <> ''").join(allowed.select("id"), "id", "left_semi")
    kept = each.groupBy("run_id", "claim_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "id"))), lambda x: x["id"]).alias("kept"))
    out = rows.join(kept, ["run_id", "claim_no"], "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    status = F.when((F.size("kept") == 0) | (F.col("score") < 0.5), "rejected").otherwise("review")
    return out.select("run_id", "claim_no", F.array_join("kept", "|").alias("ids"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), "score")), 6).alias("confidence"), status.alias("status"))


def transcript(claims: DataFrame) -> DataFrame:
    """Three lines for each claim(claim_id, status, parts array<double>): proposer, critic, judge with the unclamped sum."""
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    lines = F.array(*(F.struct(F.lit(k).alias("line"), F.lit(who).alias("speaker"), what.alias("said")) for k, (who, what) in enumerate((
        ("proposer", F.lit("proposed")), ("critic", F.concat(F.size("parts").cast("string"), F.lit(" parts"))), ("judge", F.concat(F.format_number(total, 2), F.lit(" "), F.col("status")))))))
    return claims.select("claim_id", F.explode(lines).alias("l")).select("claim_id", "l.line", "l.speaker", "l.said")


def graph_tables(entities: DataFrame, papers: DataFrame, evidence: DataFrame, relations: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, kind) of entities, papers and evidence; edges(src, dst, kind) of relations, containment and mentions (one for each mention)."""
    node = lambda df, c, kind: df.select(F.concat(F.lit(kind + ":"), F.col(c).cast("string")).alias("id"), F.lit(kind).alias("kind"))
    name = lambda c, kind: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    nodes = node(entities, "entity_id", "entity").unionByName(node(papers, "paper_id", "paper")).unionByName(node(evidence, "evidence_id", "evidence"))
    edges = relations.select(name("source", "entity").alias("src"), name("target", "entity").alias("dst"), F.col("type").alias("kind"))
    edges = edges.unionByName(evidence.select(name("paper_id", "paper").alias("src"), name("evidence_id", "evidence").alias("dst"), F.lit("CONTAINS").alias("kind")))
    return nodes, edges.unionByName(mentions.select(name("evidence_id", "evidence").alias("src"), name("entity_id", "entity").alias("dst"), F.lit("MENTIONS").alias("kind")))


def critic_faults(row_checks: dict[str, Column]) -> Column:
    """Names of the checks that are false; a missing answer is no fault."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), name) for name, c in row_checks.items())))


def diagnosis(profiles: DataFrame) -> DataFrame:
    """profiles(profile_id, scores map<string,int>, expected): mean to one place, level at 45, 60, 75 and 88, match 100 - 18 gap, weak topics under 70."""
    values = F.map_values("scores")
    mean = F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size("scores"), 1)
    level = F.when(mean <= 45, 1).when(mean <= 60, 2).when(mean <= 75, 3).when(mean <= 88, 4).otherwise(5)
    weak = F.transform(F.array_sort(F.filter(F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))), lambda e: e["v"] < 70)), lambda e: e["k"])
    return profiles.select("profile_id", mean.alias("readiness"), level.alias("level"), F.greatest(F.lit(0), 100 - 18 * F.abs(level - F.col("expected"))).alias("match"), F.array_join(weak, "|").alias("blind_spots"))


# Wordings of human verdicts.
VERDICTS = {"suitable": ("合适", "suitable", "appropriate", "fit", "ok", "适中"), "too_hard": ("偏难", "too_hard", "hard", "too hard", "过难"), "too_easy": ("偏易", "too_easy", "easy", "too easy", "过易")}


def human_verdict(c: Column) -> Column:
    """Suitable, too_hard, too_easy, or the wording itself."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    known = [F.when(F.lower(bare).isin(*names), verdict) for verdict, names in VERDICTS.items()]
    return F.coalesce(*known, bare)


def highlights(text: Column, head: Column, tail: Column) -> Column:
    """struct(head_at, tail_at): first places (from 1) of both names, whatever their case; 0 if absent or if the tail overlaps the head."""
    low = F.lower(text)
    h, t = F.instr(low, F.lower(head)), F.instr(low, F.lower(tail))
    over = (h > 0) & (t > 0) & (t < h + F.length(head)) & (h < t + F.length(tail))
    return F.struct(h.alias("head_at"), F.when(over, 0).otherwise(t).alias("tail_at"))


def topic_gaps(topics: DataFrame, rejected: DataFrame, links: DataFrame, most: int = 8) -> DataFrame:
    """topics(topic, n_papers, last_year), rejected(topic), links(a, b): sparse recent topics, topics of rejected claims, unlinked pairs of the largest topics."""
    sparse = topics.where("n_papers <= 2 AND last_year >= 2023").select(F.lit(0).alias("rule"), F.col("topic").alias("gap"))
    refused = rejected.join(topics, "topic", "left_semi").select(F.lit(1).alias("rule"), F.col("topic").alias("gap")).distinct()
    large = topics.orderBy(F.desc("n_papers"), "topic").limit(most).select("topic")
    pairs = large.select(F.col("topic").alias("a")).join(large.select(F.col("topic").alias("b")), F.col("a") < F.col("b"))  # `most` rows by `most`
    both = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    apart = pairs.join(both, ["a", "b"], "left_anti").select(F.lit(2).alias("rule"), F.concat_ws(" / ", "a", "b").alias("gap"))
    return sparse.unionByName(refused).unionByName(apart).orderBy("rule", "gap").limit(most)


def run_metrics(claims: DataFrame) -> DataFrame:
    """claims(run_id, status, n_ids, n_spans): unsupported among accepted in percent (100 when nothing is accepted)."""
    accepted = F.count(F.when(F.col("status") == "accepted", 1))
    bare = F.count(F.when((F.col("status") == "accepted") & ((F.col("n_ids") == 0) | (F.col("n_spans") == 0)), 1))
    return claims.groupBy("run_id").agg(F.count("*").alias("n"), accepted.alias("n_accepted"), F.round(F.when(accepted > 0, 100 * bare / accepted).otherwise(100.0), 4).alias("unsupported"))


def best_evidence(rows: DataFrame) -> DataFrame:
    """rows(claim_id, ordinal, status): an accepted one, else the first that needs review, else the first."""
    rank = F.when(F.col("status") == "accepted", 0).when(F.col("status") == "needs_review", 1).otherwise(2)
    best = rows.groupBy("claim_id").agg(F.min(F.struct(rank.alias("r"), "ordinal", "status")).alias("b"))
    return best.select("claim_id", "b.ordinal", "b.status")


def blocks(sentences: DataFrame, size: int, overlap: int) -> DataFrame:
    """sentences(paper_id, sentence_index, text) in blocks of `size` that share `overlap` sentences."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("sentence_index") - size + 1) / step)).cast("int")
    rows = sentences.select("paper_id", "sentence_index", "text", F.explode(F.sequence(first, F.floor(F.col("sentence_index") / step).cast("int"))).alias("block"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("paper_id", "block").agg(F.count("*").alias("n"), text.alias("text"))


def redacted(rows: DataFrame) -> DataFrame:
    """Without consent sections and source_text go."""
    for c in ("sections", "source_text"):
        rows = rows.withColumn(c, F.when(F.coalesce("consent", F.lit(False)), F.col(c)))
    return rows


# Generic mining: one document at a time, in the order of its sentences.

# Ours: cue words that give a term its type.
CUES = {"METHOD": ("method", "model", "algorithm", "network"), "DATASET": ("dataset", "corpus", "benchmark"), "METRIC": ("accuracy", "score", "error"), "TASK": ("task", "problem", "detection")}
TRIGGERS = {"IMPROVES": ("improve", "outperform"), "USES": ("use", "using", "based on"), "EVALUATES_ON": ("evaluate", "tested on"), "REPORTS": ("report", "show", "表明", "发现", "结果显示")}
TERMS, RELATIONS = 60, 80


def mine_terms(text: str) -> list[tuple[str, str, int]]:
    """(term, type, count): acronyms and capitalised runs inside sentences; two uses, or one with a cue; longest first, at most TERMS."""
    seen: dict[str, list] = {}
    for _, _, s in split_sentences(text):
        for m in re.finditer(r"[A-Z]{2,}[0-9]*|[A-Z][a-z]+(?: [A-Z][a-z]+)+", s):
            if m.start() == 0 and not m.group().isupper():
                continue
            near = s[max(0, m.start() - 40) : m.end() + 40].lower()
            kind = next((k for k, cues in CUES.items() if any(c in near for c in cues)), "")
            held = seen.setdefault(m.group(), [0, kind])
            held[0] += 1
            held[1] = held[1] or kind
    rows = [(t, k or "METHOD", n) for t, (n, k) in seen.items() if n >= 2 or k]
    return sorted(rows, key=lambda r: (-len(r[0]), r[0]))[:TERMS]


def mine_relations(text: str) -> list[tuple[str, str, str, float]]:
    """The first term of a sentence with the next two; the trigger's type or RELATED_TO; the first RELATIONS in order; min(.68, base + .02 n)."""
    terms = mine_terms(text)
    counts: dict[tuple[str, str, str], int] = {}
    for _, _, s in split_sentences(text):
        at = sorted((s.find(t), t) for t, _, _ in terms if t in s)
        kind = next((k for k, words in TRIGGERS.items() if any(w in s.lower() for w in words)), "RELATED_TO")
        for _, other in at[1:3]:
            key = (at[0][1], kind, other)
            if key in counts or len(counts) < RELATIONS:
                counts[key] = counts.get(key, 0) + 1
    return [(a, k, b, round(min(0.68, (0.50 if k == "RELATED_TO" else 0.60) + 0.02 * n), 6)) for (a, k, b), n in counts.items()]


def generic_relations(docs: DataFrame) -> DataFrame:
    """docs(paper_id, text) to (paper_id, ordinal, source, type, target, confidence), a row-wise function in Arrow batches."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<source:string,type:string,target:string,confidence:double>>")
    def mine(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("source", "type", "target", "confidence"), r)) for r in mine_relations(t or "")])

    return docs.select("paper_id", F.posexplode(mine("text")).alias("ordinal", "r")).select("paper_id", "ordinal", "r.*")


def with_fallback(guided: DataFrame, generic: DataFrame) -> DataFrame:
    """A paper's guided relations, or the generic ones where it has none."""
    spare = generic.join(guided.select("paper_id").distinct(), "paper_id", "left_anti")
    return guided.withColumn("miner", F.lit("schema")).unionByName(spare.withColumn("miner", F.lit("generic")))


def accepted_by_policy(relations: DataFrame, strict: bool = True) -> DataFrame:
    """relations(source, target, sentence, sources, targets, source_type, target_type, trigger): evidence, both names inside it, allowed types (no constraint allows), a trigger if strict."""
    inside = lambda c: F.expr(f"sentence rlike concat('(?i)(^|[^A-Za-z0-9])\\\\Q', {c}, '\\\\E($|[^A-Za-z0-9])')")
    allowed = F.col("sources").isNull() | (F.array_contains("sources", F.col("source_type")) & F.array_contains("targets", F.col("target_type")))
    checks = {"evidence": F.length(F.trim(F.coalesce("sentence", F.lit("")))) >= 20, "source_located": inside("source"), "target_located": inside("target"), "types": allowed}
    if strict:
        checks["trigger"] = F.coalesce("trigger", F.lit("")) != ""
    return relations.withColumn("faults", critic_faults(checks)).withColumn("accepted", F.size("faults") == 0)


# Ours: words that don't begin a full name.
_LEADING = frozenset("the a an of for and with while in on to by from using preceding following called named".split())


def fragment_reason(full: str, acronym: str) -> str:
    """Why a mined full name is a fragment: empty, acronym_repeated, repeated_phrase, leading_word, or '' if it isn't."""
    words, short = normalized_name(full).split(), normalized_name(acronym).split()
    if not words:
        return "empty"
    runs = lambda n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    if short and runs(len(short)).count(tuple(short)) >= 2:
        return "acronym_repeated"
    if any(len(set(runs(n))) < len(runs(n)) for n in range(2, len(words) // 2 + 1)):
        return "repeated_phrase"
    return "leading_word" if words[0] in _LEADING else ""


def merged_concepts(concepts: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """concepts(concept_id, name, type) to (concept_id, group_id, canonical, verdict).

    Equal keys (folded, separators and plurals alike) and equivalent full names of one acronym
    (definitions(acronym, full_name, concept_id)) are edges; a component of several types is a type_conflict,
    others are merged under their longest name.
    """
    ship(concepts.sparkSession)

    @F.pandas_udf("string")
    def key(names: pd.Series) -> pd.Series:
        return names.map(lambda n: " ".join(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w for w in normalized_name(n).split()))

    keyed = concepts.withColumn("_k", key("name"))
    first = keyed.where("_k <> ''").groupBy("_k").agg(F.min("concept_id").alias("dst"))
    edges = keyed.join(first, "_k").where("concept_id <> dst").select(F.col("concept_id").alias("src"), "dst")
    if definitions is not None:
        def same(rows: pd.DataFrame) -> pd.DataFrame:
            good = [r for r in rows.itertuples() if not fragment_reason(r.full_name, r.acronym)]
            found = [(max(a.concept_id, b.concept_id), min(a.concept_id, b.concept_id)) for a, b in combinations(good, 2) if a.concept_id != b.concept_id and names_equivalent(a.full_name, b.full_name)]
            return pd.DataFrame(found, columns=["src", "dst"])

        kind = concepts.schema["concept_id"].dataType.simpleString()
        edges = edges.union(definitions.distinct().groupBy("acronym").applyInPandas(same, f"src {kind}, dst {kind}"))
    found = connected_components(edges).withColumnsRenamed({"node": "_node"})
    rows = concepts.join(found, concepts["concept_id"] == found["_node"], "left").withColumn("group_id", F.coalesce("component", "concept_id"))
    per = rows.groupBy("group_id").agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("canonical"), F.countDistinct("type").alias("_t"), F.count("*").alias("_n"))
    verdict = F.when(F.col("_n") == 1, "single").when(F.col("_t") > 1, "type_conflict").otherwise("merged")
    return rows.join(per, "group_id").select("concept_id", "group_id", "canonical", verdict.alias("verdict"))


def unwrapped(page: str) -> str:
    """Hard-wrapped lines joined: a hyphen at the end is dropped if the joined word is on the page elsewhere; blank lines stay breaks."""
    known = set(re.findall(r"[a-z]+", page.lower()))
    out: list[str] = []
    for line in page.split("\n"):
        bare = line.strip()
        if out and out[-1] and bare:
            tail = re.search(r"([A-Za-z]+)-$", out[-1])
            head = re.match(r"[a-z]+", bare)
            if tail and head:
                joined = (tail.group(1) + head.group()).lower() in known
                out[-1] = (out[-1][:-1] if joined else out[-1]) + bare
                continue
            if not re.search(r"[.!?:。！？]$", out[-1]):
                out[-1] += " " + bare
                continue
        out.append(bare)
    return "\n".join(out)


# Ours: phrases that a rewriter replaces, by strength.
REWRITES = {"light": (("in order to", "to"), ("due to the fact that", "because")), "medium": (("utilize", "use"), ("a large number of", "many")), "heavy": (("moreover, ", ""), ("it is worth noting that ", ""))}


def humanized(text: Column, strength: str) -> Column:
    """The rewrites of a strength and of those below it."""
    for level in ("light", "medium", "heavy"):
        for old, new in REWRITES[level]:
            text = F.regexp_replace(text, f"(?i){re.escape(old)}", new)
        if level == strength:
            break
    return text
