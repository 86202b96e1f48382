"""SimHash near-dedup at a likeness: components of pairs whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Candidates come from SimHash fingerprints of the sets first: equal ones, and those that the vantage-point trees
link within three bits. That finds most copies with small changes, but at a likeness of 0.8 fingerprints differ
by about ten of 64 bits, a radius at which triangle bounds prune nothing (unrelated ones lie at 32 +- 4). So
that no link is lost, prefix filtering completes them: in any one order of shingles, two sets this alike share
one among the first n - ceil(0.8 n) + 1 of each. Shingles that are common in a sample come last in that order,
so that boilerplate seldom meets; the sample changes what is compared, never what is found. Every link is
an exact comparison of whole sets (of 64-bit hashes). Texts are sent for it only where the sets' parity masks (a
few bits for each shingle) leave 0.8 possible: masks differ in no more places than their sets in shingles.

Texts with equal sets are one class and meet once. Each of ROUNDS rounds compares every class with one class of
another component that leads most of its lists (the first round also the SimHash candidates), so a large group of
near copies becomes a component over about as many links as it has members; only classes of different components
are paired after that, where sizes and the shingles shared so far leave 0.8 possible.

Defined cases: words are those of simhash; null text is empty; texts of fewer than five words have one
shingle, the text; texts without words are one class; an empty table gives no rows; columns beside key and
text are ignored; a text is in a worker's memory as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.simhash import SEED, links, majority
from lumenspan.llm.tokens import column
from lumenspan.operators.components import connected_components
from lumenspan.session import discard, release, ship, stored

WORDS = 5
#: Rows of the sample, and the most shingles that it puts last.
SAMPLE_ROWS, HOT = 20_000, 200_000
#: Rounds in which classes are compared with leaders.
ROUNDS = 2
#: Parts in which prefixes are dealt by their shingles, one after the other, so that one part at a time is on the disks.
PARTS = 4
#: Bits of the broadcast table that tells which texts are surely not asked for: 131,072 rows of 64 bits at most.
ASKED_BITS = 1 << 23


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of UTF-8 bytes."""
    import xxhash

    found = raw.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    text = b" ".join(found)
    if len(found) <= words:
        return np.array([digest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return np.unique(np.array([digest(text[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64))


def prefix(found: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set, by hash; those in hot (sorted) come last, by rank."""
    if not len(found):
        return found
    order = np.zeros(len(found), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        order = np.where(hot[at] == found, rank[at] + 1, 0)
    return found[np.argsort(order, kind="stable")][: len(found) - -(-4 * len(found) // 5) + 1]


def mask(found: np.ndarray) -> bytes:
    """Parities of how many hashes end in each number of k bits; there are two to four bits for each hash, 64 at least."""
    bits = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of how many hashes are in only one of two sets, from their masks; the longer is folded to the shorter."""
    x, y = (np.frombuffer(m, np.uint8) for m in sorted((a, b), key=len))
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x))) ^ x).sum())


def _sets(docs: DataFrame, key: str) -> DataFrame:
    """(key, shingles) of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in column(batch, "text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(cut, "key long, shingles array<long>")


def _common(docs: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in three or more sets of the sample, sorted, and their ranks (the commonest last)."""
    deal = -(-docs.count() // SAMPLE_ROWS)
    rows = _sets(docs.where(F.pmod(F.xxhash64(key), F.lit(max(1, deal))) == 0), key)
    seen = rows.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    found = np.array([tuple(r) for r in seen.orderBy(F.desc("n"), "s").limit(HOT).collect()], np.int64).reshape(-1, 2)
    hot = np.ascontiguousarray(found[:, 0]).view(np.uint64)
    by_hash = np.argsort(hot)
    return hot[by_hash], (len(hot) - 1 - np.arange(len(hot)))[by_hash]


def _marked(docs: DataFrame, key: str) -> DataFrame:
    """(key, digest of the set, fp: its fingerprint, size, tokens: its prefix, mask) of every row."""
    known = docs.sparkSession.sparkContext.broadcast(_common(docs, key))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hot, rank = known.value
        for batch in batches:
            digests, prints, sizes, tokens, masks = [], [], [], [], []
            for text in column(batch, "text").cast(pa.binary()):
                found = shingle_set(text.as_py())
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append(majority(found))
                sizes.append(len(found))
                tokens.append(prefix(found, hot, rank).view(np.int64))
                masks.append(mask(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(masks, pa.binary())], ["key", "digest", "fp", "size", "tokens", "mask"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(mark, "key long, digest binary, fp long, size int, tokens array<long>, mask binary")


def _lengths(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _room(a_size: Column, a_pos: Column, b_size: Column, b_pos: Column) -> Column:
    """Whether sets that share no shingle before these places can have a likeness of 0.8."""
    return 9 * F.least(a_size - a_pos, b_size - b_pos) >= 4 * (a_size + b_size)


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (src, dst) of classes (key, size, mask) whose sizes and masks leave a likeness of 0.8 possible, written."""
    a, b = (classes.select(F.col("key").alias(end), F.col("size").alias(f"{end}_size"), F.col("mask").alias(f"{end}_mask")) for end in ("src", "dst"))
    both = pairs.join(a, "src").join(b, "dst").where(_lengths(F.col("src_size"), F.col("dst_size"))).select("src", "dst", (F.col("src_size") + F.col("dst_size")).alias("sizes"), "src_mask", "dst_mask")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # 5 shared >= 4 (sizes - shared), where apart = sizes - 2 shared
            keep = [9 * apart(x.as_py(), y.as_py()) <= n.as_py() for n, x, y in zip(*(batch.column(k) for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["src", "dst"])

    found = stored(both.mapInArrow(fit, "src long, dst long"), "possible")
    release(pairs.sparkSession)
    return found


def _asked(docs: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """(key, text) of the rows whose key is in ends, and of few others: the exact join after it sends no text that surely has no pair."""
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(ASKED_BITS))
    words = ends.select(place.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
    rows = docs.select(key, "text", place.alias("at")).withColumn("word", F.expr("at div 64"))
    return rows.join(F.broadcast(words), "word").where("getbit(bits, cast(at % 64 AS int)) = 1").select(key, "text")


def alike(pairs: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The pairs (src, dst) whose whole sets have a Jaccard likeness of 0.8 or more, written.

    Texts are sent, and their sets made where a pair's texts meet: hashes can't be compressed and are three times as large.
    """
    ends = pairs.select(F.col("src").alias(key)).union(pairs.select("dst")).distinct()
    texts = stored(_asked(docs, ends, key).join(ends, key, "left_semi"), "texts")
    release(docs.sparkSession)
    both = pairs.join(texts.select(F.col(key).alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col(key).alias("dst"), F.col("text").alias("b")), "dst").select("src", "dst", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None
        for batch in batches:
            keep = []
            for dst, a, b in zip(batch.column(1), column(batch, "a").cast(pa.binary()), column(batch, "b").cast(pa.binary())):
                if held is None or dst != last:
                    last, held = dst, shingle_set(b.as_py())
                found = shingle_set(a.as_py())
                shared = len(np.intersect1d(found, held, assume_unique=True))
                keep.append(5 * shared >= 4 * (len(found) + len(held) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["src", "dst"])

    found = stored(both.mapInArrow(compare, "src long, dst long"), "alike")
    discard(texts)
    release(docs.sparkSession)
    return found


def near_copies(docs: DataFrame, key: str) -> DataFrame:
    """(key, component): the smallest key of its component for every row; docs hold key, a distinct long, and text."""
    ship(docs.sparkSession)
    marked = stored(_marked(docs, key), "marked")
    named = stored(marked.select("key", "digest"), "named")
    prefixes = marked.groupBy("digest").agg(F.min(F.struct("key", "fp", "size", "tokens", "mask")).alias("c")).select("c.*")
    prefixes = stored(prefixes, "prefixes")
    discard(marked)
    release(docs.sparkSession)
    classes = stored(prefixes.select("key", "fp", "size", "mask"), "classes")
    rows, parts = prefixes.select(F.posexplode("tokens").alias("pos", "token"), F.col("key").alias("id"), "size"), []
    for k in range(PARTS):
        part = rows.where(F.pmod("token", F.lit(PARTS)) == k)
        several = part.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")  # a hot token is counted before it is sent, and its rows are joined in parts
        parts.append(stored(part.join(several, "token", "left_semi").select("token", "id", "size", "pos"), "lists"))
        release(docs.sparkSession)
    lists = reduce(DataFrame.union, parts)
    discard(prefixes)

    # equal fingerprints and those within three bits, each compared with the first of its group
    points = stored(classes.groupBy("fp").agg(F.min("key").alias("rep")), "points")
    close = classes.join(points, "fp").where("key <> rep").select(F.col("key").alias("src"), F.col("rep").alias("dst")).union(links(points, points.count()))

    # each class is compared with one that leads most of its lists, other leaders in every round, until few are linked anew
    edges, known = close, None
    for turn in range(ROUNDS):
        sides = lists.withColumn("part", F.col("id")) if known is None else lists.join(known, lists["id"] == known["node"], "left").select("token", "id", "size", "pos", F.coalesce("component", "id").alias("part"))
        central = F.floor(1000 * F.col("pos") / F.col("size")) if turn == 0 else F.lit(0)
        lead = F.struct(central.alias("c"), F.xxhash64("id", F.lit(turn)).alias("r"), "id", "size", "pos", "part")
        leads = sides.groupBy("token").agg(F.min(lead).alias("a"), F.max(lead).alias("b")).where("a.part <> b.part")
        led = sides.join(leads, "token").withColumn("to", F.when(F.col("a.part") != F.col("part"), F.col("a")).otherwise(F.col("b"))).where((F.col("to.part") != F.col("part")) & _lengths(F.col("size"), F.col("to.size")) & _room(F.col("size"), F.col("pos"), F.col("to.size"), F.col("to.pos")))
        best = led.groupBy("id", F.col("to.id").alias("to")).agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", (-F.col("to")).alias("t"), "to")).alias("best"))
        tried = best.select(F.col("id").alias("src"), F.col("best.to").alias("dst"))
        tried = (tried.union(close) if known is None else tried).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        tried = stored(tried, "led")
        release(docs.sparkSession)
        new = alike(possible(tried, classes), docs, key)
        edges = new if known is None else edges.union(new)
        known = stored(connected_components(edges), "known")
        release(docs.sparkSession)

    sides = lists.join(known, lists["id"] == known["node"], "left").select("token", "id", "size", "pos", F.coalesce("component", "id").alias("part"))
    a, b = (sides.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "size", "pos", "part"))) for s in "ab")
    # shared shingles come in one order in both sets: those with room are the first of them, so counts and last places below stay a bound
    met = a.join(b, "token").where("a_id < b_id AND a_part <> b_part").where(_lengths(F.col("a_size"), F.col("b_size")) & _room(F.col("a_size"), F.col("a_pos"), F.col("b_size"), F.col("b_pos")))
    met = met.groupBy("a_id", "b_id").agg(F.count("*").alias("n"), F.max(F.struct("a_pos", "b_pos")).alias("last"), F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size"))
    most = F.col("n") + F.least(F.col("a_size") - F.col("last.a_pos"), F.col("b_size") - F.col("last.b_pos")) - 1
    pairs = stored(met.where(9 * most >= 4 * (F.col("a_size") + F.col("b_size"))).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")), "pairs")
    discard(*parts)
    release(docs.sparkSession)
    found = connected_components(edges.union(alike(possible(pairs, classes), docs, key)))

    heads = named.groupBy("digest").agg(F.min("key").alias("head"))
    heads = heads.join(found, heads["head"] == found["node"], "left").select("digest", F.coalesce("component", "head").alias("component"))
    return named.join(heads, "digest").select("key", "component")
