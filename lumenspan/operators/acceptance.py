"""Evidence quality, names located by place, and the acceptance policy over both.

Defined cases: null spans are empty, null and blank names are found nowhere, null types fit no constraint, null aliases
are none; repeated rows all stay; an empty table gives no rows; rows keep all their columns, new ones must not clash.
Spans of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspan.functions.text import STEP_CHARS, ascii_edges, flat_text, symbol_ratio
from lumenspan.session import ship

# Results depend on exactly these.
SHORTEST, MOST_SYMBOLS, MOST_CITED = 20, 0.45, 0.30
#: Words that end no finished sentence.
CUT_TAILS = ("using", "such as", "in", "the", "of", "and", "or", "for", "to", "with", "by", "is", "are", "was", "were", "a", "an", "as", "that", "which", "from", "用", "和", "与", "在", "把", "被")
#: Traces of layout, and citations.
LAYOUT = r"(?i)(?:\breferences?\b|\bbibliograph|\bworks\s+cited\b|参考文献|引用文献|\btable\s+\d|\bfigure\s+\d|\bfig\.\s*\d|\bsection\s+\d|\bappendix\b)"
CITED = r"(?i)(?:\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\]|\([A-Z][^()]{0,60}\b(?:19|20)\d{2}[a-z]?\)|\((?:19|20)\d{2}[a-z]?\)|\bet\s+al\.)"
#: The passive voice between two names; stems that report results; words that link two names loosely.
PASSIVE = r"(?i)\b(?:is|are|was|were|be|been|being)\b[^.;]{0,80}?\bby\b"
REPORT_STEMS = ("report", "achiev", "obtain", "reach", "gain", "attain", "outperform", "报告", "达到", "取得", "提升到", "降至", "测得")
LINKS = r"(?i)(?:\b(?:by|for|using|use|used|uses|via|with|on|from|based\s+on|trained\s+on|applied\s+to|combined\s+with|compared\s+with|than|over)\b|使用|采用|基于|用于|针对|结合|相比|优于)"
#: Abbreviations whose full stop ends no sentence.
SHORT_FORMS = ("et al", "Fig", "Eq", "Tab", "Sec", "No", "i.e", "e.g", "vs", "cf", "ref")
# End of fixed values.

#: Every text that LAYOUT fits holds one of these, in lower case.
LAYOUT_WORDS = ("reference", "bibliograph", "works", "参考文献", "引用文献", "table", "figure", "fig.", "section", "appendix")
#: The space between two sentences of a text whose white space is single spaces, and the sign that stands for it.
BREAK = r"(?<=[.!?])(?<!(?i:\b(?:" + "|".join(map(re.escape, SHORT_FORMS)).replace(r"\ ", " ") + r")\.)) (?=[A-Z(\[]|[一-鿿])"
BREAK_SIGN = "\x01"

PLACED = T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("name", T.StringType())]))


@lru_cache(20_000)
def name_pattern(name: str) -> re.Pattern | None:
    """A name in any case, between words where it begins or ends with an ASCII letter or digit."""
    clean = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip()
    if not clean:
        return None
    edge = lambda c: c.isascii() and c.isalnum()
    left, right = "(?<![A-Za-z0-9])" if edge(clean[0]) else "", "(?![A-Za-z0-9])" if edge(clean[-1]) else ""
    return re.compile(left + re.escape(clean) + right, re.IGNORECASE)


#: Letters beyond ASCII that a pattern takes for ASCII ones in any case.
ODD = re.compile("[İıſ\u212a]")


@lru_cache(20_000)
def searched(names: tuple[str | None, ...]) -> list[tuple[str, str, re.Pattern]]:
    """(name, what a text in lower case holds where the name is in it, its pattern) of names that can be found."""
    return [(n, bare[0].lower() if (bare := re.findall("[A-Za-z0-9]+", unicodedata.normalize("NFKC", n))) else "", p) for n in names if n and (p := name_pattern(n))]


def places(text: str, names: Sequence[str | None]) -> list[tuple[int, int, str]]:
    """(begin, end, name): from the left, the longest first (then the first named), none over another."""
    low = text.lower() if text.isascii() or not ODD.search(text) else None  # looking for a word costs far less than a pattern
    hits = [(*m.span(), name) for name, word, pattern in searched(tuple(names)) if low is None or word in low for m in pattern.finditer(text)]
    if len(hits) < 2:
        return hits
    out: list[tuple[int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (h[0], h[0] - h[1])):
        if not out or hit[0] >= out[-1][1]:
            out.append(hit)
    return out


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some STEP_CHARS bytes of the texts in column `at`, so that a worker holds the results of one slice."""
    step = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // STEP_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def placed_names(rows: DataFrame, text: str, wanted: dict[str, str], flat: bool = False) -> DataFrame:
    """Rows with an array of (char_start, char_end, name) for each of wanted {new column: column of name arrays}.

    Places count in the text as it stands, which flattened() makes comparable with the names; flat=True flattens the column here.
    """
    if clash := set(wanted) & set(rows.columns):
        raise ValueError(f"the rows have columns {sorted(clash)} already")
    ship(rows.sparkSession)
    at, columns = rows.columns.index(text), [rows.columns.index(c) for c in wanted.values()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, at)):
            texts, made = batch.column(at).to_pylist(), []
            if flat:
                texts = [flat_text(t) for t in texts]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
            for c in columns:
                found, ends, lists = [], [0], batch.column(c)
                codes = lists.flatten().dictionary_encode()  # few lists differ: each is read once
                known, codes, starts = {}, codes.indices.fill_null(-1).to_numpy(), [0, *np.cumsum([len(x) if x.is_valid else 0 for x in lists])] if lists.null_count else lists.offsets.to_numpy() - lists.offsets[0].as_py()
                for row, value in enumerate(texts):
                    key = codes[starts[row] : starts[row + 1]].tobytes()
                    if (names := known.get(key)) is None:
                        names = known[key] = tuple(lists[row].as_py() or ())
                    if value and names:
                        found.extend(places(value, names))
                    ends.append(len(found))
                fields = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["char_start", "char_end", "name"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *wanted])

    return rows.mapInArrow(find, T.StructType([*rows.schema.fields, *(T.StructField(c, PLACED) for c in wanted)]))


def _codes(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), code) for code, cond in rules)))


def quality_faults(text: Column) -> Column:
    """What makes a flattened text no evidence: too_short, cut_off, symbols, citations, layout."""
    # a search for the words that a pattern needs costs far less than the pattern, and few texts hold any
    some = lambda found: reduce(lambda a, b: a | b, found)

    def faults(x: Column) -> Column:
        text, low = x["text"], x["low"]
        tail = F.substring_index(F.rtrim(low, F.lit(" .;:,、，。")), " ", -1)
        ends = F.exists(F.array(F.rtrim(low, F.lit(" \t\n\x0b\f\r"))), lambda s: some(s.endswith(w) for w in CUT_TAILS))
        cut = tail.isin(*CUT_TAILS) | ends & (tail != "")
        cited = F.when(some(low.contains(w) for w in ("[", "(", "al.")), (F.length(text) - F.length(F.regexp_replace(text, ascii_edges(CITED), ""))) / F.length(text)).otherwise(0.0)
        layout = some(low.contains(w) for w in LAYOUT_WORDS) & text.rlike(ascii_edges(LAYOUT))
        return _codes([("too_short", F.length(text) < SHORTEST), ("cut_off", cut), ("symbols", symbol_ratio(text) > MOST_SYMBOLS), ("citations", cited > MOST_CITED), ("layout", layout)])

    text = F.coalesce(text, F.lit(""))
    # a lambda's argument is found once, an expression inside it at every place
    return F.get(F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), faults), F.lit(0))


def decided(relations: DataFrame, constraints: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], triggers: dict[str, tuple[str, ...]], strict: bool = True, one_sentence: bool = True) -> DataFrame:
    """relations(span, head, head_aliases, head_type, tail, tail_aliases, tail_type, type) with status and reasons.

    1. No good evidence: rejected with the faults of quality_faults(). 2. A name that isn't in the span: rejected
    (head_missing, tail_missing); names that are in it more than once wait for review (not_unique). 3. Types inside the
    constraints of the relation's type (heads, tails; none or empty ones allow all), the head before the tail (reversed), no passive
    between them (passive), both in one sentence (other_sentence). 4. Between them a trigger of the relation's type or a stem
    that reports; loosely a linking word as well (adjacent, no_trigger). Accepted without any reason, else needs_review.
    Places are those of the first hits, in the flattened span, which is kept as `text` beside n_head and n_tail.
    """
    kind = F.upper(F.coalesce("type", F.lit("")))
    names = lambda own, more: F.array_compact(F.concat(F.array(own), F.coalesce(more, F.array().cast("array<string>"))))
    rows = relations.withColumns({"text": F.col("span"), "_heads": names("head", "head_aliases"), "_tails": names("tail", "tail_aliases")})
    rows = placed_names(rows, "text", {"_h": "_heads", "_t": "_tails"}, flat=True)
    rows = rows.withColumns({"n_head": F.size("_h"), "n_tail": F.size("_t"), "_head": F.get("_h", F.lit(0)), "_tail": F.get("_t", F.lit(0)), "_faults": quality_faults(F.col("text"))})
    head, tail = F.col("_head"), F.col("_tail")
    cut = lambda text, a, b: F.substring(text, a + 1, F.greatest(F.lit(0), b - a))

    typed = F.lit(True)
    for name, (heads, tails) in constraints.items():
        fits = lambda c, some: F.coalesce(F.upper(c).isin(*(x.upper() for x in some)), F.lit(False)) if some else F.lit(True)
        typed = F.when(kind == name.upper(), fits("head_type", heads) & fits("tail_type", tails)).otherwise(typed)
    begin, end = F.least(head["char_end"], tail["char_end"]), F.greatest(head["char_start"], tail["char_start"])
    between = cut(F.col("text"), begin, end)
    low = F.lower(between)
    present = reduce(lambda a, b: a | b, [low.contains(s) for s in REPORT_STEMS])
    for name, some in triggers.items():
        for word in filter(None, some):
            word = word.lower()
            found = low.rlike(rf"(?<![a-z0-9]){re.escape(word)}") if word.isascii() else between.contains(word)
            present = present | (kind == name.upper()) & found
    if not strict:
        present = present | between.rlike(ascii_edges(LINKS))
    first, last = F.least(head["char_start"], tail["char_start"]), F.greatest(head["char_start"], tail["char_start"])
    marked = reduce(lambda a, b: a | b, [F.col("text").contains(f"{sign} ") for sign in ".!?"])  # no break without them
    apart = marked & cut(F.regexp_replace("text", ascii_edges(BREAK), BREAK_SIGN), first, last).contains(BREAK_SIGN)

    backward = head["char_start"] > tail["char_start"]
    missing = _codes([("head_missing", F.col("n_head") == 0), ("tail_missing", F.col("n_tail") == 0)])
    doubts = _codes([
        ("not_unique", (F.col("n_head") > 1) | (F.col("n_tail") > 1)), ("types", ~typed), ("reversed", backward),
        ("passive", ~backward & cut(F.col("text"), head["char_end"], tail["char_start"]).rlike(ascii_edges(PASSIVE))), ("other_sentence", apart if one_sentence else F.lit(False)),
        ("adjacent", end <= begin), ("no_trigger", (end > begin) & ~present),
    ])
    reasons = F.when(F.size("_faults") > 0, F.col("_faults")).when(F.size(missing) > 0, missing).otherwise(doubts)
    rows = rows.withColumn("reasons", reasons)  # a column of its own: the doubts of a row are found once
    status = F.when((F.size("_faults") > 0) | (F.col("n_head") == 0) | (F.col("n_tail") == 0), "rejected").when(F.size("reasons") > 0, "needs_review").otherwise("accepted")
    return rows.select(*[c for c in rows.columns if c != "reasons"], status.alias("status"), "reasons").drop("_heads", "_tails", "_h", "_t", "_head", "_tail", "_faults")
