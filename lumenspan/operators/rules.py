"""Predicates, rankings and small rules of the review and retrieval paths.

Nulls: a null text counts as empty, a null flag as false, null keys join nothing. Empty tables give no rows
(reports: one row of zeros). Extra columns are ignored unless a docstring says that rows stay whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.text import compatible

#: Fixed values of the definitions: predicates that claim too much, words that anchor nothing, thresholds of confidence.
ABSOLUTE = ("guarantees", "proves")
NO_ANCHOR = ("how", "what", "why", "using", "based", "develop", "design")
NO_TERM = ("the", "and", "with", "如何", "什么", "怎么")
NO_CHINESE_TERM = ("如何", "基于", "开发", "一个", "可以", "什么")
HIGH_FIDELITY = 0.7
#: Patterns of search tokens, of Latin anchors and of Chinese terms in a question.
QUERY_TOKEN, ANCHOR, CHINESE_TERM = r"[a-z0-9][a-z0-9.+#/-]{1,}|[一-鿿]{2,}", r"[A-Za-z][A-Za-z0-9.+#/-]{2,}", r"[一-鿿]{2,6}"
#: Signs cut from the ends of a concept's name, and what is dropped inside it: all but letters, digits, spaces, + - / and _.
EDGE_SIGNS = "()[]{}<>,;:\"'`*†‡§¶·—–-_. "
CONCEPT_DROPPED = r"[^\p{L}\p{N}_一-鿿 +\-/]+"
#: English search terms by what a Chinese request names.
SEARCH_TERMS = ("scientific literature", (("entity extraction relation extraction", ("抽取",)), ("knowledge graph", ("知识图谱", "图谱")), ("research idea generation", ("想法", "idea"))))
# End of fixed values.


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def folded(label: Column) -> Column:
    """White space squeezed to single spaces, in lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " ")))


def query_tokens(query: str, stop: tuple[str, ...] = ()) -> list[str]:
    """Distinct Latin tokens of two signs or more and runs of Chinese of a query, in order."""
    import re

    return [t for t in dict.fromkeys(re.findall(QUERY_TOKEN, query.casefold())) if t not in stop]


def _count(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))


def relevant(query: str, query_domain: str, paper_domain: Column, evidence: Column, general: str = "general") -> Column:
    """The same routed domain, or for a general query at least two of its tokens inside the paper's text."""
    if query_domain != general:
        return F.coalesce(paper_domain == query_domain, F.lit(False))
    low = F.lower(F.coalesce(evidence, F.lit("")))
    return _count([low.contains(t) for t in query_tokens(query)]) >= 2


def dual_attach(papers: DataFrame, query: str, query_domain: str, general: str = "general") -> DataFrame:
    """papers(paper_id, domain, text) to (paper_id, domain, relevance): their own at 1.0, the query's at 0.8 where it differs and P06 holds."""
    own = papers.select("paper_id", "domain", F.lit(1.0).alias("relevance"))
    other = papers.where((F.col("domain") != query_domain) & relevant(query, query_domain, F.col("domain"), F.col("text"), general))
    return own.union(other.select("paper_id", F.lit(query_domain).alias("domain"), F.lit(0.8).alias("relevance")))


def federated_rank(papers: DataFrame, query: str, n: int) -> DataFrame:
    """papers(paper_id, title, summary, tier, year): official first, then overlap (title 3, elsewhere 1), authority and length, then year; ties by id."""
    title, text = F.lower(_text("title")), F.lower(F.concat_ws(" ", _text("title"), _text("summary")))
    overlap = reduce(lambda a, b: a + b, [F.when(title.contains(t), 3).when(text.contains(t), 1).otherwise(0) for t in query_tokens(query)], F.lit(0))
    score = overlap + F.greatest(F.lit(0), 4 - F.col("tier")) * 2 + F.least(F.lit(2.0), F.char_length(_text("summary")) / 500)
    rows = papers.select("paper_id", (F.col("tier") == 1).cast("int").alias("official"), F.round(score, 6).alias("score"), "year")
    return rows.orderBy(F.desc("official"), F.desc("score"), F.desc("year"), "paper_id").limit(n)


def library_search(papers: DataFrame, query: str, domain: str, n: int, first: int = 100, general: str = "general") -> DataFrame:
    """papers(paper_id, domain, text, tier, year, relevance, retrieval_count) of the routed domain for a query.

    The `first` by tier, relevance, retrieval count and year (ties: the smaller id) are cut off, then ranked by overlap, tier
    and year; ties keep the order of the cut. In the general domain two tokens or more must be in the text. The limits
    are the feature: both are top-k cuts.
    """
    order = [F.asc("tier"), F.desc("relevance"), F.desc("retrieval_count"), F.desc("year"), F.asc("paper_id")]
    cut = papers.where(F.col("domain") == domain).orderBy(*order).limit(first)
    low = F.lower(_text("text"))
    rows = cut.withColumn("overlap", _count([low.contains(t) for t in query_tokens(query, NO_TERM)]))
    rows = rows if domain != general else rows.where("overlap >= 2")
    out = rows.orderBy(F.desc("overlap"), "tier", F.desc("year"), *order).limit(n)
    return out.select("paper_id", "overlap", "tier", "year")


def fallback_relevant(query: str, papers: DataFrame) -> DataFrame:
    """One row (relevant): do papers(text) answer the query together? Without papers: false.

    Some Latin anchor of the query (three signs or more) must be in some paper's text; without anchors some Chinese term.
    """
    return papers.agg(F.coalesce(F.bool_or(fallback_hit(query, F.col("text"))), F.lit(False)).alias("relevant"))


def fallback_hit(query: str, text: Column) -> Column:
    """Does one text hold an anchor of the query (without anchors: a Chinese term)?"""
    import re

    low = F.lower(F.coalesce(text, F.lit("")))
    anchors = [t for t in dict.fromkeys(x.lower() for x in re.findall(ANCHOR, query)) if t not in NO_ANCHOR]
    terms = [t for t in re.findall(CHINESE_TERM, query) if t not in NO_CHINESE_TERM]
    return reduce(lambda a, b: a | b, [low.contains(t) for t in anchors or terms], F.lit(False))


def retrieval_query(query: Column) -> Column:
    """English search terms for a Chinese request; others stay as they are."""
    has = lambda words: reduce(lambda a, b: a | b, [F.lower(query).contains(w) for w in words])
    terms = F.concat_ws(" ", F.lit(SEARCH_TERMS[0]), *(F.when(has(words), term) for term, words in SEARCH_TERMS[1]))
    return F.when(query.rlike("[一-鿿]"), terms).otherwise(query)


def trigger_pattern(trigger: str) -> str:
    """A trigger as a pattern: Latin ones as whole words with any white space inside, others as they stand."""
    import re

    body = r"\s+".join(re.escape(w) for w in trigger.split())
    return rf"(?i)(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])" if re.fullmatch(r"[A-Za-z0-9 _\-/]+", trigger) else f"(?i){body}"


def trigger_type(text: Column, triggers: list[tuple[str, tuple[str, ...]]], none: str = "RELATED_TO") -> Column:
    """The relation type of the trigger that begins first (then ends first, then is listed first); `none` without any."""
    hits = []
    for order, (kind, words) in enumerate((k, w) for k, some in triggers for w in some):
        at = F.regexp_instr(text, F.lit(trigger_pattern(words)))
        size = F.char_length(F.regexp_extract(text, trigger_pattern(words), 0))
        hits.append(F.when(at > 0, F.struct(at.alias("at"), (at + size).alias("to"), F.lit(order).alias("n"), F.lit(kind).alias("kind"))))
    return F.coalesce(F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))["kind"], F.lit(none)) if hits else F.lit(none)


def in_order(text: Column, needle: str) -> Column:
    """Do the needle's words come in the text's words, in their order?"""
    import re

    wanted = re.findall("[a-z0-9]+", needle.casefold())
    if not wanted:
        return F.lit(False)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![a-z0-9])(?:{'|'.join(dict.fromkeys(wanted))})(?![a-z0-9])"), F.lit(0))
    # how many of the needle's words were met in order: each word of the text is looked at once
    met = F.aggregate(words, F.lit(0), lambda k, w: F.when(w == F.get(F.array(*map(F.lit, wanted)), k), k + 1).otherwise(k))
    return met == len(wanted)


def concept_keys(name: Column, singular) -> Column:
    """Keys of a name by case, by separators as well, and by plurals as well; singular is a function of a word column.

    Letters of any script count; compatible signs (NFKC) and case are folded first.
    """
    edge = "[" + "".join("\\" + c if c in "[]-\\" else c for c in EDGE_SIGNS) + "]+"
    bare = compatible(F.regexp_replace(F.coalesce(name, F.lit("")), f"^{edge}|{edge}$", ""))
    case = F.trim(F.regexp_replace(F.regexp_replace(bare, CONCEPT_DROPPED, ""), " +", " "))
    words = F.filter(F.split(F.regexp_replace(case, r"[-_/\s]+", " "), " "), lambda w: w != "")
    return F.struct(case.alias("case_key"), F.array_join(words, " ").alias("separator_key"), F.array_join(F.transform(words, singular), " ").alias("plural_key"))


def rule_critic(claims: DataFrame, progressive: tuple[str, ...]) -> DataFrame:
    """claims(claim_id, n_evidence, n_invalid, relation, relation_type, types_valid, covers_both, confidence) to codes of what is wrong.

    covers_both is null where no span was cited. 'consistent' stands alone where nothing is wrong.
    """
    relation = F.lower(_text("relation"))
    rules = [
        ("no_evidence", F.col("n_evidence") == 0), ("invalid_evidence", F.col("n_invalid") > 0), ("single_source", F.col("n_evidence") == 1),
        ("absolute_predicate", relation.isin(*ABSOLUTE)), ("progressive_predicate", reduce(lambda a, b: a | b, [relation.contains(m) for m in progressive], F.lit(False))),
        ("cooccurrence_only", F.col("relation_type") == "RELATED_TO"), ("type_mismatch", ~F.col("types_valid")),
        ("ends_not_covered", ~F.col("covers_both")), ("low_confidence", F.col("confidence") < HIGH_FIDELITY),
    ]
    codes = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), code) for code, cond in rules)), lambda c: c.isNotNull())
    return claims.select("claim_id", F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("consistent"))).alias("criticisms"))


def guarded(decisions: DataFrame) -> DataFrame:
    """decisions(claim_id, status, n_valid, relation): rejected without valid evidence or with an absolute predicate, whatever was decided."""
    stop = (F.coalesce("n_valid", F.lit(0)) == 0) | F.lower(_text("relation")).isin(*ABSOLUTE)
    return decisions.select("claim_id", F.when(stop, "rejected").otherwise(F.col("status")).alias("status"), (stop & (F.col("status") != "rejected")).alias("overruled"))


def browsed(relations: DataFrame, status: str | None = None, decision: str | None = None, word: str = "", n: int = 200) -> DataFrame:
    """relations(relation_id, source, target, kind, status, decision) by status, decision and a word in their names; the first n by id (the feature)."""
    rows = relations
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if decision is not None:
        rows = rows.where(F.coalesce("decision", F.lit("undecided")) == decision)
    if word:
        rows = rows.where(F.lower(F.concat_ws(" ", "source", "kind", "target")).contains(word.lower()))
    return rows.orderBy("relation_id").limit(n)


def evidence_papers(papers: DataFrame, excluded: DataFrame) -> DataFrame:
    """papers(paper_id, ...) that are no metadata alone (excluded: paper_id); rows stay whole."""
    return papers.join(excluded.select("paper_id").distinct(), "paper_id", "left_anti")


def case_subset(cases: DataFrame, variants=(), ids=(), errors=()) -> DataFrame:
    """P10: cases(variant, claim_id, error_type, ...) of the variants, ids and error types asked for; an empty choice is all."""
    for column, wanted in (("variant", variants), ("claim_id", ids), ("error_type", errors)):
        if wanted:
            cases = cases.where(F.col(column).isin(*wanted))
    return cases


def runnable(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """runs(run_id) with the number of their evidence rows and whether they may start at all."""
    n = evidence.groupBy("run_id").agg(F.count("*").alias("n_evidence"))
    return runs.join(n, "run_id", "left").select("run_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.col("n_evidence").isNotNull().alias("may_start"))


def undone(decisions: DataFrame, cleared: DataFrame) -> DataFrame:
    """decisions(project_id, relation_id, ...) without those that were cleared: their relations are undecided again."""
    return decisions.join(cleared.select("project_id", "relation_id").distinct(), ["project_id", "relation_id"], "left_anti")


def snapshot(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """edges(project_id, relation_id) as the next version of each project, one row for each relation: (project_id, version, relation_id).

    versions(project_id, version, relation_id) holds the earlier ones. A row for each id keeps large projects apart.
    """
    last = versions.groupBy("project_id").agg(F.max("version").alias("_last"))
    return edges.select("project_id", "relation_id").distinct().join(last, "project_id", "left").select("project_id", (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("version"), "relation_id")


def shown_answer(answers: DataFrame) -> DataFrame:
    """answers(session_id, answer_id, created, shown): the last shown one of each session (ties: the greatest id)."""
    return answers.where("shown").groupBy("session_id").agg(F.max(F.struct("created", "answer_id"))["answer_id"].alias("answer_id"))


def roles(projects: DataFrame, members: DataFrame) -> DataFrame:
    """(project_id, user_id, role): owner of projects(project_id, user_id), else the role in members(project_id, user_id, role)."""
    own = projects.where("user_id IS NOT NULL").select("project_id", "user_id", F.lit("owner").alias("role"))
    other = members.join(projects.select("project_id"), "project_id", "left_semi").join(own, ["project_id", "user_id"], "left_anti")
    return own.union(other.select("project_id", "user_id", "role"))


def usage(calls: DataFrame) -> DataFrame:
    """calls(failed, retries, input_tokens, output_tokens, duration_ms) summed up; tokens and time of failed calls don't count."""
    good = ~F.coalesce("failed", F.lit(False))
    total = lambda c, cond=F.lit(True): F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return calls.agg(
        F.count_if(good).alias("calls"), F.count_if(~good).alias("failed_calls"), total("retries").cast("long").alias("retries"),
        total("input_tokens", good).cast("long").alias("input_tokens"), total("output_tokens", good).cast("long").alias("output_tokens"), F.round(total("duration_ms", good), 1).cast("double").alias("duration_ms"),
    )


def page_quality(pages: DataFrame) -> DataFrame:
    """pages(document_id, page, text, n_images) to counts by document.

    Empty pages (under 10 signs), pages whose text another page has as well (all of them, empty ones too), pages with
    replacement signs, scans (under 50 signs and an image), all signs and words; a document is a scan if over half of its
    pages are.
    """
    text = F.regexp_replace(_text("text"), r"^\s+|\s+$", "")
    rows = pages.select(
        "document_id", "page", F.char_length(text).alias("n"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"), F.sha2(text.cast("binary"), 256).alias("h"),
        text.contains("�").alias("bad"), F.coalesce("n_images", F.lit(0)).alias("images"),
    )
    scan = (F.col("n") < 50) & (F.col("images") > 0)
    same = rows.groupBy("document_id", "h").agg(
        F.count("*").alias("c"), F.count_if(F.col("n") < 10).alias("empty"), F.count_if("bad").alias("bad"), F.count_if(scan).alias("scanned"), F.sum("n").alias("n"), F.sum("words").alias("words"),
    )
    out = same.groupBy("document_id").agg(
        F.sum("c").alias("n_pages"), F.sum("empty").alias("n_empty"), F.sum("bad").alias("n_replacement"), F.sum("scanned").alias("n_scanned"),
        F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n_duplicate"), F.sum("n").alias("n_chars"), F.sum("words").alias("n_words"),
    )
    return out.withColumn("is_scanned", 2 * F.col("n_scanned") > F.col("n_pages"))


def adaptation_summary(verdicts: DataFrame, human: DataFrame, wilson) -> DataFrame:
    """Verdicts of the rule (path_id, gap, coverage, mastered_share, suitable) beside human(path_id, verdict: suitable, too_hard, too_easy).

    Accuracy by either, which condition failed how often, the Wilson interval, their agreement and the gates: 0.85, 100 labels, a lower bound of 0.80.
    """
    both = verdicts.join(human.where(F.col("verdict").isin("suitable", "too_hard", "too_easy")), "path_id", "left")
    fits = F.col("verdict") == "suitable"
    out = both.agg(
        F.count("*").alias("n"), F.count_if("suitable").alias("n_rule"), F.count_if(F.col("gap") > 1).alias("failed_gap"), F.count_if(F.col("coverage") < 0.8).alias("failed_coverage"), F.count_if(F.col("mastered_share") > 0.2).alias("failed_mastered"),
        F.count("verdict").alias("n_human"), F.count_if(fits).alias("n_suitable"), F.count_if(fits == F.col("suitable")).alias("n_agree"),
    )
    safe = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    low, high = wilson(F.col("n_suitable"), F.col("n_human"))
    claim = (F.col("n_human") >= 100) & (F.coalesce(F.col("n_suitable") / F.nullif("n_human", F.lit(0)), F.lit(0.0)) >= 0.85) & (low >= 0.80)
    return out.withColumns({"rule_accuracy": safe("n_rule", "n"), "human_accuracy": safe("n_suitable", "n_human"), "agreement": safe("n_agree", "n_human"), "low": F.round(low, 6), "high": F.round(high, 6), "can_claim": claim})


