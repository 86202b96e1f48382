"""Phrase collocations: a sketch names the candidates, automata count them, thresholds come last.

1. Words are counted, which also gives the number of words N.
2. Hashed phrases of two and three words are counted in a sketch of 2 N / LOAD cells. A cell's count is an upper bound of
   the count of every phrase in it. The sketch lies in slices of CELLS cells: a task sends the cells that it met, and each
   slice is summed up where it arrives. No sketch is held whole.
3. Phrases whose cell reaches `least` are candidates: no phrase that is frequent enough can be missing. A table of ENTRIES
   levels, the powers of two that bound the cells, tells a scan which phrases to send; the cells are joined afterwards.
   With the counts of the FREQUENT commonest words it also leaves out phrases whose score can't reach the first of FLOORS;
   languages whose last reported phrase doesn't reach that floor either are done again with the next.
4. Word counts and the cell bound each candidate's score from above. The best by that bound, their parts and the phrases
   that hold them are compiled into Aho-Corasick automata of bounded size, each word between delimiters. Every shard of the
   texts is scanned for overlapping matches, counts are summed over the shards, and thresholds hold on the sums.
5. Candidates whose bound reaches the last phrase that was reported, but which were not counted, are counted likewise.

Memory is bounded whatever the corpus is. Texts are read three times, and once for every PATTERN_CHARS characters of
phrases to count, which depend on the phrases asked for rather than on all frequent ones.

Defined cases: null text is empty; null lang is `und`; texts, pieces and languages without words give nothing; repeated
rows count each time; an empty table gives no rows; extra columns are ignored. A slice of about TEXT_BYTES, or one
longer text, is in a worker's memory, and its words are numbered in runs of RUN.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column, slices
from lumenspan.session import ship, stored

#: Cells of a slice of the sketch, phrases for each cell, bytes of the table of levels, characters of an automaton.
BITS = 20
CELLS, LOAD, ENTRIES, PATTERN_CHARS = 1 << BITS, 0.5, 1 << 25, 8 << 20
#: Words whose counts every task knows, and scores below which phrases are not listed at first.
FREQUENT, FLOORS = 1 << 16, (100_000, 0)
#: A cell that counts this is full, and bounds nothing.
FULL = (1 << 32) - 1
#: So many times the phrases asked for are counted at first.
AHEAD = 10
#: Languages that are left out of a further round by a broadcast.
SURE = 10_000
#: Words that are numbered together; words that a task counts before it sends them; phrases that a row of cells is made of.
RUN, HELD_WORDS, HELD_GRAMS = 1 << 20, 200_000, 1 << 21
#: Bytes of text that are cut into words at once (one text at least).
TEXT_BYTES = 2 << 20

#: Ends of pieces become full stops, which no word holds, tabs become spaces, A-Z small letters.
GUARD = b"."
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b",;:!?\n\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + GUARD * 9 + b" ")
#: Odd numbers to mix hashes with.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def guarded(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in order, with a guard wherever a piece or a text ends."""
    return GUARD.join(texts).translate(CLEAN).replace(GUARD, b" . ").split()


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, guarded words) of a batch's texts, slice by slice."""
    texts, langs = column(batch, "text"), batch.column(batch.schema.get_field_index("lang")).to_pylist()
    for a, b in slices(texts, TEXT_BYTES):
        found: dict[str, list[bytes]] = {}
        for lang, text in zip(langs[a:b], texts.slice(a, b - a).cast(pa.binary()).to_pylist()):
            found.setdefault(lang, []).append(text)
        for lang, some in found.items():
            if words := guarded(some):
                yield lang, words


class Numbers(dict):
    """Words numbered as they come; the guard is 0."""

    def __init__(self) -> None:
        super().__init__({GUARD: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def hashed(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, from the hashes of their words."""
    import xxhash

    with np.errstate(over="ignore"):
        out = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64) + np.uint64(len(words))
        for w in words:
            out = (out ^ w) * np.uint64(MIX[0])
            out ^= out >> np.uint64(29)
        for factor in MIX[1:3]:
            out = (out ^ (out >> np.uint64(31))) * np.uint64(factor)
        return out ^ (out >> np.uint64(30))


class Grams(NamedTuple):
    """The different phrases of one size in a run of words: hashes, counts, a place of each, the numbers of their words;
    and for every place of such a phrase (`at`) which it is (`back`)."""

    size: int
    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    ids: list[np.ndarray]
    at: np.ndarray
    back: np.ndarray
    run: list[bytes]
    words: list[bytes]


def grams(lang: str, words: list[bytes]) -> Iterator[Grams]:
    """Phrases of two, then of three words of each run of words; runs overlap by two words."""
    import xxhash

    for begin in range(0, len(words), RUN):
        run = words[begin : begin + RUN + 2]
        numbers = Numbers()
        ids = np.fromiter(map(numbers.__getitem__, run), np.int64, len(run))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        for size in (2, 3):
            starts = min(len(run) - size + 1, RUN)
            if starts <= 0:
                continue
            columns = [ids[k : k + starts] for k in range(size)]
            inside = np.flatnonzero(np.all([c > 0 for c in columns], axis=0))
            packed = np.zeros(len(inside), np.int64)  # at most RUN + 3 numbers, three of which fit
            for c in columns:
                packed = packed * len(numbers) + c[inside]
            packed, first, back, counts = np.unique(packed, return_index=True, return_inverse=True, return_counts=True)
            places = inside[first]
            mine = [c[places] for c in columns]
            yield Grams(size, hashed(lang, [hashes[c] for c in mine]), counts, places, mine, inside, back, run, list(numbers))


def placed(hashes: np.ndarray, n_slices: int) -> np.ndarray:
    """slice * CELLS + cell of each hash."""
    cell = (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    return ((hashes >> np.uint64(BITS)) % np.uint64(n_slices)).astype(np.int64) * CELLS + cell


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): all occurrences of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, some in held.items() for word, n in some.items() if word != GUARD]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, words in by_language(batch):
                held.setdefault(lang, Counter()).update(words)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield sent()
        yield sent()

    ship(docs.sparkSession)
    return _texts(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def heavy_cells(docs: DataFrame, n_slices: int, least: int) -> DataFrame:
    """(slice, cells, bounds, levels): cells of the sketch that at least `least` phrases fell into, as 32-bit integers.

    A level is the power of two above the counts of some neighbouring cells, 0 where none is heavy.
    """
    entries = min(CELLS, 1 << int(math.log2(max(1, ENTRIES // n_slices))))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            places, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(places)
            places = places[order]
            starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            counts = np.minimum(np.add.reduceat(counts[order], starts), FULL).astype(np.uint32)
            places = places[starts]
            which, first = np.unique(places // CELLS, return_index=True)
            bounds = [*first.tolist(), len(places)]
            cells = (places % CELLS).astype(np.uint32)
            cut = list(zip(bounds, bounds[1:]))
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([cells[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in cut], pa.binary())], ["slice", "cells", "counts"])

        for batch in batches:
            for lang, words in by_language(batch):
                for g in grams(lang, words):
                    held.append((placed(g.hashes, n_slices), g.counts))
                    size += len(g.counts)
                if size > HELD_GRAMS:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                into = sums.setdefault(number, np.zeros(CELLS, np.uint32))
                at, more = np.frombuffer(cells.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint32)
                into[at] += np.minimum(more, FULL - into[at])
        for number, into in sums.items():
            heavy = np.flatnonzero(into >= least).astype(np.uint32)
            levels = np.zeros(entries, np.uint8)
            np.maximum.at(levels, heavy // (CELLS // entries), np.where(into[heavy] >= FULL, 255, np.ceil(np.log2(into[heavy] + 1.0))).astype(np.uint8))
            cells = [pa.array([x.tobytes()], pa.binary()) for x in (heavy, into[heavy], levels)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *cells], ["slice", "cells", "bounds", "levels"])

    spark = docs.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_slices // 16)
    return _texts(docs).mapInArrow(sketch, "slice long, cells binary, counts binary").repartition(tasks, "slice").mapInArrow(total, "slice long, cells binary, bounds binary, levels binary")


def _cells(heavy: DataFrame) -> DataFrame:
    """(place, bound): a row for each heavy cell; bound is null where the cell is full."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, cells, bounds in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                places, bound = np.frombuffer(cells.as_buffer(), np.uint32).astype(np.int64) + number * CELLS, np.frombuffer(bounds.as_buffer(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(bound, mask=bound >= FULL)], ["place", "bound"])

    return heavy.select("slice", "cells", "bounds").mapInArrow(rows, "place long, bound long")


class Sketch:
    """The heavy cells of a corpus, its table of levels and its commonest words, to list candidates with."""

    def __init__(self, docs: DataFrame, words: DataFrame, least: int):
        spark = docs.sparkSession
        n_words = words.agg(F.sum("n").alias("n")).first()["n"] or 0
        self.n_slices = max(1, math.ceil(2 * n_words / (LOAD * CELLS)))
        self.heavy = stored(heavy_cells(docs, self.n_slices, least), "heavy_cells")
        rows = self.heavy.select("slice", "levels").collect()  # ENTRIES bytes, or one for each slice
        table = np.zeros((self.n_slices, max((len(r["levels"]) for r in rows), default=1)), np.uint8)
        for r in rows:
            table[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
        common: dict[str, dict[bytes, int]] = {}
        for r in words.orderBy(F.desc("n"), "lang", "word").limit(FREQUENT).collect():
            common.setdefault(r["lang"], {})[r["word"].encode()] = r["n"]
        self.step = CELLS // table.shape[1]
        self.levels, self.common = spark.sparkContext.broadcast(table.reshape(-1)), spark.sparkContext.broadcast(common)

    def candidates(self, docs: DataFrame, floor: int = 0) -> DataFrame:
        """(lang, phrase, bound): phrases whose cell is heavy and whose score may reach `floor`, and heavy phrases that hold one."""
        levels, common, step, n_slices = self.levels, self.common, self.step, self.n_slices

        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[str, bytes], int] = {}

            def sent() -> pa.RecordBatch:
                rows, places = list(seen), list(seen.values())
                seen.clear()
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array(places, pa.int64())], ["lang", "phrase", "place"])

            for batch in batches:
                for lang, words in by_language(batch):
                    counts_of = common.value.get(lang, {})
                    pairs = None
                    for g in grams(lang, words):
                        asked = placed(g.hashes, n_slices)
                        level = levels.value[asked // step]
                        known = np.array([counts_of.get(w, 1) for w in g.words], np.float64)
                        # a phrase occurs as often as its last or first word at most, so its score is under a / count of either
                        passed = (level > 0) & (1e6 * np.exp2(level.astype(np.float64)) >= floor * np.maximum(known[g.ids[0]], known[g.ids[-1]]))
                        if g.size == 2:
                            pairs = np.ones(len(g.run) + 1, bool)
                            pairs[g.at] = passed[g.back]
                        else:  # all places of a phrase have the same pairs
                            passed |= (level > 0) & (pairs[g.places] | pairs[g.places + 1])
                        hit = np.flatnonzero(passed)
                        seen.update(((lang, b" ".join(g.run[p : p + g.size])), at) for p, at in zip(g.places[hit].tolist(), asked[hit].tolist()))
                    if len(seen) > HELD_WORDS:
                        yield sent()
            yield sent()

        listed = _texts(docs).mapInArrow(names, "lang string, phrase string, place long").distinct()
        return listed.join(_cells(self.heavy), "place").select("lang", "phrase", "bound")


_AUTOMATA: dict = {}


def automata(name: str, patterns: pa.Table) -> dict:
    """An automaton for each language over delimited phrases; a worker keeps those of one broadcast."""
    import ahocorasick

    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        made: dict = {}
        for number, (lang, phrase) in enumerate(zip(patterns["lang"], patterns["phrase"])):
            lang = lang.as_py()
            if lang not in made:
                made[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            made[lang].add_word(f" {phrase.as_py()} ", number)
        for one in made.values():
            one.make_automaton()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def counted(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a): occurrences of each of phrases(lang, phrase), overlapping ones too, inside pieces; none: no row."""
    spark = docs.sparkSession
    ship(spark)
    size = phrases.agg(F.sum(F.length("phrase") + 2).alias("n")).first()["n"] or 0
    shards = math.ceil(size / PATTERN_CHARS)
    dealt = phrases.select("lang", "phrase", F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, shards))).cast("int").alias("shard"))
    out = spark.createDataFrame([], "lang string, phrase string, a long")
    for k in range(shards):
        sink = pa.BufferOutputStream()
        table = dealt.where(F.col("shard") == k).select("lang", "phrase").toArrow()  # about PATTERN_CHARS characters
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        out = out.unionByName(_scanned(docs, spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex))
    return out.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _scanned(docs: DataFrame, patterns, name: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(patterns.value).read_all().combine_chunks()
        known = automata(name, table)
        counts = np.zeros(len(table), np.int64)
        for batch in batches:
            for lang, words in by_language(batch):
                if lang in known:
                    text = f" {b' '.join(words).decode()} "
                    found = Counter(map(itemgetter(1), known[lang].iter(text)))
                    counts[np.fromiter(found.keys(), np.int64, len(found))] += np.fromiter(found.values(), np.int64, len(found))
        met = np.flatnonzero(counts)
        for batch in table.take(met).append_column("a", pa.array(counts[met])).to_batches(max_chunksize=100_000):
            yield batch

    return _texts(docs).mapInArrow(scan, "lang string, phrase string, a long")


def _big(name: str) -> Column:
    return F.col(name).cast("decimal(18,0)")


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits."""
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (_big(a) * _big(a)).cast("decimal(31,0)"), (_big(left) * _big(right)).cast("decimal(38,0)"))


def _of(table: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """A table's (lang, key, value) as (lang, name, n_name), to join by name."""
    return table.select("lang", F.col(key).alias(name), F.col(value).alias(f"n_{name}"))


def bounded(listed: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Candidates with w0, w1, w2 (null: two words), head and tail, the counts of their words, bound and best.

    (best, bound) is at least (score, count): a is at most the cell's count and every word's count; of three words, a part
    of two occurs a times or more, so the score is at most 1000000 a / the count of the word beside it.
    """
    part = F.split("phrase", " ")
    rows = listed.select("lang", "phrase", "bound", *(F.get(part, F.lit(k)).alias(f"w{k}") for k in range(3)))
    single = words.where(F.col("n") >= least)
    for k in range(3):
        rows = rows.join(_of(single, f"w{k}", "word", "n"), ["lang", f"w{k}"], "inner" if k < 2 else "left")
    rows = rows.where(F.col("w2").isNull() | F.col("n_w2").isNotNull()).withColumn("bound", F.least("bound", "n_w0", "n_w1", "n_w2"))
    three = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * _big("bound"), F.greatest("n_w0", "n_w2").cast("decimal(18,0)"))
    pair = F.col("w2").isNull()
    return rows.withColumns({"head": F.when(~pair, F.concat_ws(" ", "w0", "w1")), "tail": F.when(~pair, F.concat_ws(" ", "w1", "w2")), "best": F.when(pair, score_of("bound", "n_w0", "n_w1")).otherwise(three)})


def scored(asked: DataFrame, exact: DataFrame, known: DataFrame, least: int, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of those asked for that are frequent and in no longer phrase with `share` percent of their count."""
    rows = asked.join(exact, ["lang", "phrase"]).where(F.col("a") >= least)
    longer = known.where(F.col("w2").isNotNull()).join(exact, ["lang", "phrase"]).where(F.col("a") >= least)
    inside = longer.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    pairs = rows.where(F.col("w2").isNull()).join(inside, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    pairs = pairs.select("lang", "phrase", "a", F.col("n_w0").alias("l"), F.col("n_w1").alias("r"), score_of("a", "n_w0", "n_w1").alias("score"))
    triples = rows.where(F.col("w2").isNotNull())
    for name in ("head", "tail"):
        triples = triples.join(_of(exact, name, "phrase", "a"), ["lang", name])
    triples = triples.withColumns({"_s1": score_of("a", "n_w0", "n_tail"), "_s2": score_of("a", "n_head", "n_w2")})
    first = F.col("_s1") <= F.col("_s2")
    return pairs.unionByName(triples.select("lang", "phrase", "a", F.when(first, F.col("n_w0")).otherwise(F.col("n_head")).alias("l"), F.when(first, F.col("n_tail")).otherwise(F.col("n_w2")).alias("r"), F.least("_s1", "_s2").alias("score")))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count (at least `least`), l and r those of its parts at the cut with the lowest
    score = floor(1000000 a a / (l r)), n the language's words. A phrase goes if a longer one that holds it has `share`
    percent of its count.
    """
    words = stored(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    sketch = Sketch(docs, words, least)
    out = None
    for floor in FLOORS:
        found = _best(docs, stored(bounded(sketch.candidates(docs, floor), words, least), "candidates"), least, share, top)
        if floor:
            sure = found.where((F.col("rank") == top) & (F.col("score") >= floor)).select("lang")
            sure = F.broadcast(sure) if (n_sure := sure.count()) <= SURE else sure
            found = found.join(sure, "lang", "left_semi")
        out = found if out is None else out.unionByName(found)
        if floor and n_sure == totals.count():
            break
        if floor and n_sure:
            docs = _texts(docs).join(sure, "lang", "left_anti")
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _best(docs: DataFrame, known: DataFrame, least: int, share: int, top: int) -> DataFrame:
    """The first `top` phrases of each language among candidates, by counts of all that may be among them."""
    asked = stored(_first(known, AHEAD * top, "best", "bound").drop("rank"), "asked")
    exact = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long")
    done = exact.select("lang", "phrase")
    while True:
        pairs = asked.where(F.col("w2").isNull()).select("lang", "phrase")
        triples = known.where(F.col("w2").isNotNull())
        around = [triples.join(pairs.withColumnRenamed("phrase", name), ["lang", name], "left_semi").select("lang", "phrase") for name in ("head", "tail")]
        parts = asked.where(F.col("w2").isNotNull()).select("lang", F.explode(F.array("head", "tail")).alias("phrase"))
        names = asked.select("lang", "phrase").unionByName(parts).unionByName(around[0]).unionByName(around[1]).distinct()
        names = stored(names.join(done, ["lang", "phrase"], "left_anti"), "names")
        exact, done = stored(exact.unionByName(counted(docs, names)), "counts"), done.unionByName(names)
        found = stored(_first(stored(scored(asked, exact, known, least, share), "scored"), top, "score", "a"), "found")
        last = found.where(F.col("rank") == top).select("lang", F.col("score").alias("_s"), F.col("a").alias("_a"), F.col("phrase").alias("_p"))
        below = (F.col("best") < F.col("_s")) | (F.col("best") == F.col("_s")) & ((F.col("bound") < F.col("_a")) | (F.col("bound") == F.col("_a")) & (F.col("phrase") > F.col("_p")))
        missing = known.join(last, "lang", "left").where(F.col("_s").isNull() | ~below).drop("_s", "_a", "_p")
        missing = stored(missing.join(asked, ["lang", "phrase"], "left_anti").select(*asked.columns), "asked")
        if missing.isEmpty():
            return found
        asked = asked.unionByName(missing)


def _first(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    """The first `top` phrases of each language, first among about as many groups as keep both steps' windows alike."""
    groups = max(1, math.isqrt(rows.count() // top))
    order = [*(F.desc(k) for k in keys), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    some = ranked(rows.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(groups))), "lang", "_group").drop("_group", "rank")
    return ranked(some, "lang")
