"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit. A superstep sorts the pieces without a place and the gaps of open sequences together
by size, dealt to partitions by range. Each partition sweeps its range from small to large: a gap takes the
largest piece so far that nobody took (so a piece goes to its successor among the gaps, and of several pieces
that want one gap the largest gets it). What a range leaves over is matched across ranges by rank: from the
counts of each range follows which run of leftover pieces meets which run of leftover gaps. Then the gaps are
updated, and the superstep repeats. A gap that holds the largest piece left several times over is offered as
several. Where the gaps together hold less than the pieces left, the largest pieces open as many sequences as
the rest needs at least. The state of each superstep is a written table; to the driver come the histogram
of lengths (capacity rows at most) and three numbers for each partition.

Defined cases: null text is empty (one piece that holds the end id alone); rows with equal or null ids are
packed each for itself (a row number, given once and written, tells them apart); an empty table gives no
rows; extra columns are ignored. A batch of about SLICE_BYTES, or one longer text, is in a worker's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column, encoder, slices, tokenizer_path
from lumenspan.session import discard, ship, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SWEPT = "row long, length int, seq long, slot int, free int, part int, rank long"
#: Openers of one length up to which they are taken in order, beyond which by a hash of their number.
FEW = 1000


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Token pieces of whole texts: only documents over the capacity are cut, the first piece takes what is left over."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(0)
            for a, b in slices(texts):
                yield _pieces(coder, keys.slice(a, b - a), texts.slice(a, b - a), end_id, capacity)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _pieces(coder, keys: pa.Array, texts: pa.Array, end_id: int, capacity: int) -> pa.RecordBatch:
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    whole = np.insert(ids.astype("<u4"), ends, end_id)
    raw = memoryview(whole.tobytes())
    row, piece, start, length, crc = [], [], [], [], []
    at = 0
    for k, n in enumerate((counts + 1).tolist()):
        first = n % capacity or capacity
        begin = 0
        number = 0
        while begin < n:
            size = first if not number else capacity
            row.append(k)
            piece.append(number)
            start.append(begin)
            length.append(size)
            crc.append(zlib.crc32(raw[4 * (at + begin) : 4 * (at + begin + size)]))
            begin += size
            number += 1
        at += n
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
        ["doc_id", "piece", "start", "length", "ids_crc32"],
    )


def match(kinds: list[int]) -> list[tuple[int, int]]:
    """(piece, gap) places in a sequence of 0 (piece) and 1 (gap) that ascends by size: each gap takes the last piece before it that is free."""
    waiting: list[int] = []
    out = []
    for k, gap in enumerate(kinds):
        if not gap:
            waiting.append(k)
        elif waiting:
            out.append((waiting.pop(), k))
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of one range, and after them what is left over, ranked: gaps, pieces."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    size, kind, key, slot, free = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(5))
    pairs = np.array(match(kind.tolist()), np.int64).reshape(-1, 2)
    over = np.ones(len(kind), bool)
    over[pairs.ravel()] = False
    rest = [np.flatnonzero(over & (kind == k)) for k in (0, 1)]
    part = TaskContext.get().partitionId()

    def batch(pieces: np.ndarray | None, gaps: np.ndarray | None, ranked: bool) -> pa.RecordBatch:
        n = len(pieces if pieces is not None else gaps)
        row, length = (pa.nulls(n, t) if pieces is None else pa.array(x[pieces], t) for x, t in ((key, pa.int64()), (size, pa.int32())))
        seq, at, left = (pa.nulls(n, t) if gaps is None else pa.array(x[gaps], t) for x, t in ((key, pa.int64()), (slot, pa.int32()), (free, pa.int32())))
        rank = pa.array(np.arange(n), pa.int64()) if ranked else pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([row, length, seq, at, left, pa.array(np.full(n, part), pa.int32()), rank], [x.split()[0] for x in SWEPT.split(", ")])

    yield batch(pairs[:, 0], pairs[:, 1], False)
    yield batch(rest[0], None, True)
    yield batch(None, rest[1], True)


def across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (first number, size, part of the pieces, its last rank, part of the gaps, its first rank) for (part, pieces, gaps) left over, in order.

    In a range the gaps left over come before the pieces left over; a gap takes the last piece that is free.
    """
    waiting: list[list[int]] = []
    out, number = [], 0
    for part, pieces, gaps in counts:
        first = 0
        while first < gaps and waiting:
            top = waiting[-1]
            n = min(gaps - first, top[1])
            out.append((number, n, top[0], top[1] - 1, part, first))
            number, first, top[1] = number + n, first + n, top[1] - n
            if not top[1]:
                waiting.pop()
        if pieces:
            waiting.append([part, pieces])
    return out


def _openers(left: DataFrame, counts: dict[int, int], n: int) -> DataFrame:
    """About n of the largest pieces: all above a length, and of the pieces of that length as many as are missing."""
    taken, bound = 0, max(counts) + 1
    while bound - 1 in counts and taken + counts[bound - 1] <= n or bound - 1 not in counts and bound > 1:
        bound -= 1
        taken += counts.get(bound, 0)
    more, have = n - taken, counts.get(bound - 1, 0)
    whole = left.where(F.col("length") >= bound)
    if not more or not have:
        return whole
    tied = left.where(F.col("length") == bound - 1)
    if more <= FEW:
        return whole.union(tied.orderBy("_row").limit(more))
    return whole.union(tied.where(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < (more << 20) // have))


def pack(pieced: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = pieced.sparkSession
    ship(spark)
    rows = stored(pieced.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    left, gaps, used = rows.select("_row", F.col("length").cast("int").alias("length")), None, []
    placed: list[DataFrame] = []
    while counts := {r["length"]: r["n"] for r in left.groupBy("length").agg(F.count("*").alias("n")).collect()}:  # capacity rows at most
        least = min(counts)
        room = gaps.where(F.col("free") >= least).agg(F.sum("free").cast("long").alias("s"), F.count("*").alias("n")).first() if gaps is not None else {"s": None, "n": 0}
        need = sum(length * n for length, n in counts.items()) - (room["s"] or 0)
        # pieces over half the capacity never share a sequence, and no gap of an older one that holds them is left after one sweep
        new = max(-(-need // capacity), 0 if room["n"] else sum(n for length, n in counts.items() if 2 * length > capacity))
        if new > 0:
            opened = stored(_openers(left, counts, new).select("_row", "length", F.col("_row").alias("seq"), F.lit(0).alias("offset")), "opened")
            placed.append(opened)
            fresh = opened.select("seq", (capacity - F.col("length")).alias("free")).where(F.col("free") >= least)
            gaps = fresh if gaps is None else gaps.where(F.col("free") >= least).union(fresh)
            left = left.join(opened.select("_row"), "_row", "left_anti")
        else:
            gaps = gaps.where(F.col("free") >= least)
        # a gap of the largest piece left several times over is several slots
        largest, share = max(counts), max(1, -(-2 * sum(counts.values()) // max(1, room["n"] + new)))
        slots = F.least(F.greatest(F.lit(1), F.floor(F.col("free") / largest)), F.lit(share)).cast("int")
        offered = gaps.withColumn("_slots", slots).select("seq", "free", "_slots", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)).alias("slot"))
        size = F.when(F.col("slot") == 0, F.col("free") - (F.col("_slots") - 1) * largest).otherwise(F.lit(largest))
        both = left.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("_row").alias("key"), F.lit(0).alias("slot"), F.lit(0).alias("free")).union(
            offered.select(size.cast("int").alias("size"), F.lit(1).alias("kind"), F.col("seq").alias("key"), "slot", "free"))
        order = ("size", "kind", "key", "slot")
        swept = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT), "swept")
        over = swept.groupBy("part").agg(F.count_if(F.col("seq").isNull()).alias("pieces"), F.count_if(F.col("row").isNull()).alias("gaps")).orderBy("part").collect()  # a row for each partition
        runs = F.broadcast(spark.createDataFrame(across([tuple(r) for r in over]), "_number long, _n long, _pieces int, _last long, _gaps int, _first long"))
        pieces_left = swept.where("seq IS NULL").join(runs, (F.col("part") == F.col("_pieces")) & F.col("rank").between(F.col("_last") - F.col("_n") + 1, F.col("_last")), "left")
        gaps_left = swept.where("row IS NULL").join(runs, (F.col("part") == F.col("_gaps")) & F.col("rank").between(F.col("_first"), F.col("_first") + F.col("_n") - 1), "left")
        met = pieces_left.where("_n IS NOT NULL").select("row", "length", (F.col("_number") + F.col("_last") - F.col("rank")).alias("_match")).join(
            gaps_left.where("_n IS NOT NULL").select((F.col("_number") + F.col("rank") - F.col("_first")).alias("_match"), "seq", "slot", "free"), "_match")
        matched = swept.where("row IS NOT NULL AND seq IS NOT NULL").select("row", "length", "seq", "slot", "free").union(met.select("row", "length", "seq", "slot", "free"))
        before = F.coalesce(F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        now = stored(matched.select(F.col("row").alias("_row"), "length", "seq", (capacity - F.col("free") + before).cast("int").alias("offset"), "free"), "placed")
        placed.append(now.select("_row", "length", "seq", "offset"))
        gaps = stored(
            now.select("seq", "free", "length").union(gaps_left.where("_n IS NULL").select("seq", "free", F.lit(0)))
            .groupBy("seq").agg((F.max("free") - F.sum("length")).cast("int").alias("free")).where("free > 0"), "gaps")
        left = pieces_left.where("_n IS NULL").select(F.col("row").alias("_row"), "length")
        used.append((swept, gaps))
        if len(used) > 2:  # nothing refers to the tables of the superstep before the last
            discard(*used.pop(0))
    if not placed:
        return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = placed[0]
    for more in placed[1:]:
        done = done.union(more)
    done = done.select("_row", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return rows.join(done, "_row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)
