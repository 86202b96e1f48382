"""SimHash near duplicates, linked by vantage-point trees over Hamming distance.

Two fingerprints within three bits differ by at most one bit in one of their halves. For each half there
is a tree whose levels split by the exact Hamming distance to a vantage point. By the triangle bound a
half at distance one lies one step nearer to or farther from every vantage point, so a fingerprint is at
home in one shard and a guest in the few shards beyond its boundaries, and no other shard can hold a
partner. Inside a shard a vantage-point tree over all 64 bits prunes by the bound of three bits; its
leaves compare exactly. Shards give spanning edges, not pairs; components join them across shards.

At the levels below the first a guest may lie on either side, so a further level doubles the guests: with three
levels a fingerprint is in ten shards, with seven in about 130.

A shard that outgrows SHARD_ROWS is dealt into blocks whose pairs cover all of its rows, so a large
group of near copies never meets in one task.

Defined cases: null text is empty; texts without words have fingerprint zero and link like others; rows
with equal ids each get a row; null ids take the component of their fingerprint; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column
from lumenspan.operators.components import connected_components
from lumenspan.session import ship, stored

BITS = 3
SHARD_ROWS = 16384
SEED = 42
#: Distinct fingerprints up to which three levels are enough; each further level serves eight times as many.
LEVEL_ROWS = 1 << 24
#: Cells of a comparison matrix in a leaf.
LEAF = 1 << 20


def simhash(raw: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint of UTF-8 bytes: majority bits of the XXH64 of its word shingles."""
    import xxhash

    found = raw.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    text = b" ".join(found)
    if len(found) <= words:
        hashes = [digest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = [0, *ends[:-words].tolist()]
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """Signed number of the bits that are set in over half of 64-bit hashes (zero without any)."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint of every whole text."""
    ship(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(t.as_py()) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, fp long")


def vantage_points(tree: int, levels: int) -> list[int]:
    """Fixed pseudo-random 32-bit points."""
    import xxhash

    return [xxhash.xxh64_intdigest(f"vantage {tree} {k}".encode(), SEED) & 0xFFFFFFFF for k in range(levels)]


def shards(points: DataFrame, levels: int) -> DataFrame:
    """(cell, fp, rep, home): each fingerprint at home in its shard of either tree, and a guest beyond the boundaries."""
    places = []
    for tree in (0, 1):
        half = (F.shiftrightunsigned("fp", 32) if tree else F.col("fp")).bitwiseAND(0xFFFFFFFF)
        steps = [F.bit_count(half.bitwiseXOR(F.lit(v))) for v in vantage_points(tree, levels)]
        cell = F.lit(tree).cast("long")
        for d in steps:
            cell = cell * 64 + d + 1
        # one step outwards at the first level, one step either way at the others
        for guest in range(1 << (levels - 1)):
            shift = 64 ** (levels - 1) + sum((1 if guest >> k & 1 else -1) * 64**k for k in range(levels - 1))
            places.append(F.struct((cell + shift).alias("cell"), F.lit(False).alias("home")))
        places.append(F.struct(cell.alias("cell"), F.lit(True).alias("home")))
    return points.select("fp", "rep", F.explode(F.array(*places)).alias("p")).select("p.cell", "fp", "rep", "p.home")


def _dealt(rows: DataFrame, levels: int) -> DataFrame:
    """Adds block: shards over SHARD_ROWS are dealt into pairs of blocks, all others are one block."""
    counts = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).select("cell", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("deal"))
    if levels == 3:  # 2 * 34**3 shards at most
        counts = F.broadcast(counts)
    salted = rows.join(counts, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("deal", F.lit(1))).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("deal", F.lit(1)) - 1),
        lambda other: F.struct((F.least(F.col("salt"), other) * 1000003 + F.greatest(F.col("salt"), other)).cast("long").alias("block"), (other == F.col("salt")).alias("own")),
    )
    return salted.withColumn("b", F.explode(pairs)).select("cell", "b.block", "salt", "fp", "rep", "home")


def join_near(points: np.ndarray, home: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each point the first index of its group, where a home point and any other within `bits` are linked."""
    root = np.arange(len(points))

    def leaf(rows: np.ndarray, among: np.ndarray) -> None:
        high = max(1, LEAF // max(1, len(among)))
        for a in range(0, len(rows), high):
            some = rows[a : a + high]
            near = np.bitwise_count(points[some, None] ^ points[None, among]) <= bits
            for k in np.flatnonzero(near.sum(axis=1) > 1):
                tops = root[among[near[k]]]
                while (tops != (higher := root[tops])).any():
                    tops = higher
                root[tops] = tops.min()

    def search(rows: np.ndarray, among: np.ndarray, depth: int) -> None:
        if len(rows) * len(among) <= LEAF or depth > 40:
            return leaf(rows, among)
        vantage = points[rows[0]]
        near, far = np.bitwise_count(points[rows] ^ vantage), np.bitwise_count(points[among] ^ vantage)
        middle = int(np.median(near))
        inner, outer = near <= middle, near > middle
        if not outer.any():
            inner, outer = near < middle, near >= middle
            middle -= 1
        if not inner.any() or not outer.any():
            return leaf(rows, among)
        search(rows[inner], among[far <= middle + bits], depth + 1)
        search(rows[outer], among[far > middle - bits], depth + 1)

    search(np.flatnonzero(home), np.arange(len(points)), 0)
    while (root != (higher := root[root])).any():
        root = higher
    return root


def links(points: DataFrame, count: int) -> DataFrame:
    """Spanning edges (src, dst) between representatives (fp, rep) whose fingerprints differ by at most BITS bits."""
    ship(points.sparkSession)
    levels = 3
    while count > LEVEL_ROWS * 8 ** (levels - 3):
        levels += 1
    rows = _dealt(shards(points, levels), levels).repartition("cell", "block").sortWithinPartitions("cell", "block", "rep").select("cell", "block", "fp", "rep", "home")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def edges() -> pa.RecordBatch:
            fp, rep, home = (np.concatenate(x) for x in zip(*held))
            root = join_near(fp.view(np.uint64), home)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], ["src", "dst"])

        for batch in batches:
            cell, block, fp, rep = (batch.column(k).to_numpy() for k in range(4))
            home = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                if a == b:
                    continue
                if (cell[a], block[a]) != key:
                    if held:
                        yield edges()
                    held, key = [], (cell[a], block[a])
                held.append((fp[a:b], rep[a:b], home[a:b]))
        if held:
            yield edges()

    return rows.mapInArrow(span, "src long, dst long").where("src <> dst")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every document."""
    marked = stored(fingerprints(docs), "fingerprints")
    points = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    edges = links(points.where("rep IS NOT NULL"), points.count())
    found = connected_components(edges)
    classes = points.join(found, points["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
