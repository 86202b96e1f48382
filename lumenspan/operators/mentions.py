"""Dictionary mentions by automata, trigger spans, pairs of mentions and their direction.

A row's mentions stand in an array beside it, so finding them, pairing them and turning them round needs no shuffle.

Defined cases: null text has no mentions; an empty dictionary finds none; blank aliases are dropped; equal aliases
(letter case apart) count once, for the smallest (alias, concept, type); repeated rows all stay; an empty table gives no
rows; all columns of the rows are kept, and the new array must not clash with one of them. Texts of any length are
searched whole; an Arrow batch and its matches are in a worker's memory.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspan.session import ship

# Results depend on exactly these.
#: Aliases of these signs alone are found between words only; others, Chinese ones for instance, anywhere.
WORDLIKE = re.compile(r"[A-Za-z0-9 _\-/]+")
#: Characters between a trigger and the nearest mention of its pair.
ADJACENT = 40
# End of fixed values.

#: Characters of one automaton (about 60 bytes each in a worker); longer dictionaries are searched part by part.
AUTOMATON_CHARS = 4 << 20
#: Characters of a dictionary at most: it goes through the driver.
DICTIONARY_CHARS = 64 << 20

MENTION = T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("concept", T.StringType()), T.StructField("type", T.StringType())]))
TRIGGER = T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("type", T.StringType())]))


class _Folding(dict):
    """A letter for each letter, whatever its case: matching that ignores case, with places kept."""

    def __missing__(self, code: int) -> int:
        sign = chr(code)
        upper = sign.upper()
        low = (upper if len(upper) == 1 else sign).lower()
        self[code] = out = ord(low[0])
        return out


_FOLDING = _Folding()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDING)


def _plain(sign: str) -> bool:
    return sign.isascii() and sign.isalnum()


#: What counts as part of a word beside an alias.
BOUNDARIES = {"ascii": _plain, "unicode": str.isalnum}


def entries(dictionary: Iterable[tuple] | DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(alias, concept, type) by length, longest first, then by alias; of aliases that differ in case alone the smallest."""
    if isinstance(dictionary, DataFrame):
        total = dictionary.agg(F.sum(F.length("alias")).alias("n")).first()["n"] or 0
        if total > DICTIONARY_CHARS:
            raise ValueError(f"a dictionary of {total} characters; {DICTIONARY_CHARS} at most")
        kind = F.col("type").cast("string") if "type" in dictionary.columns else F.lit(None).cast("string")
        dictionary = map(tuple, dictionary.select("alias", F.col("concept").cast("string"), kind).collect())
    rows = sorted({(a, None if c is None else str(c), *(rest or (None,))) for a, c, *rest in dictionary if a and a.strip()}, key=lambda r: (-len(r[0]), tuple(x or "" for x in r)))
    seen: set[str] = set()
    return [r for r in rows if not ((low := folded(r[0])) in seen or seen.add(low))]


def parts(rows: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Runs of entries of about `most` characters."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[0]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[0])
    if held:
        yield held


class Finder:
    """An automaton over folded aliases, and which of its hits are mentions."""

    def __init__(self, rows: list[tuple], boundary: str):
        import ahocorasick

        self.lengths = [len(r[0]) for r in rows]
        self.between_words = [bool(WORDLIKE.fullmatch(r[0])) for r in rows]
        self.in_word = BOUNDARIES[boundary]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, row in enumerate(rows):
            self.automaton.add_word(folded(row[0]), number)
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(entry, begin, end), sorted: where each alias stands, from the left, never over itself."""
        found, text = [], folded(text)
        for last, number in self.automaton.iter(text):
            end, begin = last + 1, last + 1 - self.lengths[number]
            if self.between_words[number] and (begin and self.in_word(text[begin - 1]) or end < len(text) and self.in_word(text[end])):
                continue
            found.append((number, begin, end))
        found.sort()
        out, now, free = [], -1, 0
        for hit in found:
            if hit[0] != now or hit[1] >= free:
                out.append(hit)
                now, free = hit[0], hit[2]
        return out

    def mentions(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Sorted (begin, end, entry) that lie apart: the intervals taken before (entry -1), then longer aliases first."""
        out = sorted(taken)
        for number, begin, end in self.hits(text):
            at = bisect_left(out, (begin,))
            if (at == len(out) or end <= out[at][0]) and (at == 0 or out[at - 1][1] <= begin):
                out.insert(at, (begin, end, number))
        return out


_FINDERS: dict = {}


def _finder(name: str, rows: list[tuple], boundary: str) -> Finder:
    """A worker builds each broadcast part once and keeps the last few."""
    if name not in _FINDERS:
        while len(_FINDERS) > 7:
            _FINDERS.pop(next(iter(_FINDERS)))
        _FINDERS[name] = Finder(rows, boundary)
    return _FINDERS[name]


def located(rows: DataFrame, dictionary: Iterable[tuple] | DataFrame, text: str = "text", out: str = "mentions", boundary: str = "ascii") -> DataFrame:
    """Rows with an array of mentions (char_start, char_end, concept, type), greedily, longest aliases first.

    dictionary: (alias, concept[, type]) tuples, or a DataFrame with such columns. Parts of a dictionary that is too long for
    one automaton come one after the other, longest aliases first: each fills what those before left free, so the result
    is that of one. boundary: `ascii` letters and digits bound a word, or `unicode` ones.
    """
    if out in rows.columns:
        raise ValueError(f"the rows have a column {out} already")
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary {boundary!r}")
    spark, names = rows.sparkSession, rows.columns
    ship(spark)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, MENTION)])
    done = rows.withColumn(out, F.array().cast(MENTION))
    for part in parts(entries(dictionary), AUTOMATON_CHARS):
        done = done.mapInArrow(_stage(spark.sparkContext.broadcast(part), uuid.uuid4().hex, names.index(text), boundary), schema)
    return done


def _stage(part, name: str, place: int, boundary: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _finder(name, part.value, boundary)
        concepts, kinds = (pa.array([r[k] for r in part.value], pa.string()) for k in (1, 2))
        for batch in batches:
            before = batch.column(batch.num_columns - 1)
            earlier = len(before.flatten())
            offsets = before.offsets.to_numpy() - before.offsets[0].as_py()
            old = list(zip(*(before.flatten().field(k).to_pylist() for k in (0, 1)))) if earlier else []
            found, ends = [], [0]
            for row, value in enumerate(batch.column(place)):
                taken = [(*old[k], k - earlier) for k in range(offsets[row], offsets[row + 1])]
                found.extend(known.mentions(value.as_py(), taken) if value.is_valid else taken)
                ends.append(len(found))
            entry = np.array([f[2] for f in found], np.int64) + earlier  # earlier mentions first, then this part's entries
            pick = lambda k, new: pa.concat_arrays([before.flatten().field(k).cast(pa.string()), new]).take(pa.array(entry))
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pick(2, concepts), pick(3, kinds)]
            array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["char_start", "char_end", "concept", "type"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], array], batch.schema.names)

    return find


def trigger_pattern(trigger: str) -> re.Pattern:
    """A trigger between words where it is made of such signs, its spaces as any white space."""
    body = r"\s+".join(map(re.escape, trigger.split(" ")))
    return re.compile(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])" if WORDLIKE.fullmatch(trigger) else body, re.IGNORECASE)


def triggered(rows: DataFrame, triggers: list[tuple[str, tuple[str, ...]]], text: str = "text", out: str = "triggers") -> DataFrame:
    """Rows with an array of all trigger spans (char_start, char_end, type) by place; earlier (type, triggers) first at one place."""
    if out in rows.columns:
        raise ValueError(f"the rows have a column {out} already")
    ship(rows.sparkSession)
    known = [(trigger_pattern(t.strip()), kind) for kind, some in triggers for t in some if t.strip()]
    place = rows.columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = [], [0]
            for value in batch.column(place).to_pylist():
                if value:
                    found.extend(sorted(((*m.span(), kind) for pattern, kind in known for m in pattern.finditer(value)), key=lambda h: h[:2]))
                ends.append(len(found))
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
            array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["char_start", "char_end", "type"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, array], [*batch.schema.names, out])

    return rows.mapInArrow(find, T.StructType([*rows.schema.fields, T.StructField(out, TRIGGER)]))


def first_of_each(mentions: Column) -> Column:
    """The first mention of each concept in an array that is sorted by place."""
    return F.filter(mentions, lambda m, i: ~F.exists(F.slice(mentions, F.lit(1), i), lambda n: n["concept"].eqNullSafe(m["concept"])))


def pairs(rows: DataFrame, window: int = ADJACENT, *keep: str) -> DataFrame:
    """N04 `trigger_between`: pairs (source, target, type) of a row's first mentions that a trigger joins.

    rows have `mentions` and `triggers`; a trigger must lie between the two, or at most `window` characters before the
    first or after the second. The first trigger by place counts; pairs without one are no relation. `keep` names columns
    to carry. A row's pairs are made inside the row.
    """
    first = first_of_each(F.col("mentions"))
    both = F.flatten(F.transform(F.col("_first"), lambda m, i: F.transform(F.slice("_first", i + 2, F.size("_first")), lambda n: F.struct(m.alias("s"), n.alias("t")))))
    rows = rows.where((F.size("mentions") > 1) & (F.size("triggers") > 0)).withColumn("_first", first)
    rows = rows.select(*keep, "triggers", F.explode(both).alias("_p"))
    left, right = F.col("_p.s"), F.col("_p.t")

    def joins(t: Column) -> Column:
        between = (left["char_end"] <= t["char_start"]) & (t["char_end"] <= right["char_start"])
        before = (t["char_end"] <= left["char_start"]) & (left["char_start"] - t["char_end"] <= window)
        after = (right["char_end"] <= t["char_start"]) & (t["char_start"] - right["char_end"] <= window)
        return between | before | after

    hit = F.get(F.filter("triggers", joins), F.lit(0))
    out = rows.withColumn("_t", hit).where(F.col("_t").isNotNull())
    return out.select(*keep, left["concept"].alias("source"), left["type"].alias("source_type"), right["concept"].alias("target"), right["type"].alias("target_type"), F.col("_t.type").alias("type"))


def oriented(rows: DataFrame, constraints: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """Source and target change places where the type's constraints (sources, targets) fit only the other way round."""
    swap = F.lit(False)
    for kind, (sources, targets) in constraints.items():
        fits = lambda a, b: F.coalesce(F.col(a).isin(*sources) & F.col(b).isin(*targets), F.lit(False))  # noqa: B023, E731
        swap = swap | F.coalesce(F.col("type") == kind, F.lit(False)) & ~fits("source_type", "target_type") & fits("target_type", "source_type")
    either = lambda a, b: F.when(F.col("_swap"), F.col(b)).otherwise(F.col(a))
    out = rows.withColumn("_swap", swap)
    return out.withColumns({"source": either("source", "target"), "target": either("target", "source"), "source_type": either("source_type", "target_type"), "target_type": either("target_type", "source_type")}).drop("_swap")


def relations(found: DataFrame, evidence: str = "evidence_id") -> DataFrame:
    """(source, target, type) with its distinct evidence and confidence min(.96, .78 + .03 n (n - 1) / 2)."""
    keys = ["source", "target", "type", "source_type", "target_type"]
    out = found.groupBy(*keys).agg(F.countDistinct(evidence).alias("n_evidence"))
    return out.withColumn("confidence", F.round(F.least(F.lit(0.96), 0.78 + 0.03 * F.col("n_evidence") * (F.col("n_evidence") - 1) / 2), 6))
