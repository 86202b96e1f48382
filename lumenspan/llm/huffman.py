"""Canonical length-limited Huffman coding of token ids, in independent blocks with checkpoints.

A coded folder holds `book` (id, bits: the code lengths, from counts over all documents) and `blocks`,
in ascending doc_id order. A block holds whole documents: their ids, their token counts, the coded bits
and the bit offset of every CHECKPOINT-th token, so a reader decodes all stretches of a block side by
side with one table look-up a token. `part` and `before` order the blocks and count the ids before them.

Defined cases: null text is empty (the end id alone); documents with equal ids keep their rows; null
ids come first; an empty table gives an empty folder and no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column, encoder, slices, tokenizer_path
from lumenspan.session import shared_dir, ship

LIMIT = 16
BLOCK_IDS = 1 << 18
CHECKPOINT = 128
ROWS = "doc_id long, n_tokens long, ids binary"
BLOCKS = "part int, block long, before long, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, checkpoints binary, bits binary"


def token_rows(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Every document's ids with the end id appended, as zstd-compressed little-endian 32-bit numbers split by byte."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, squeeze = encoder(path), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(0)
            for a, b in slices(texts):
                ids, counts = coder.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                whole = np.insert(ids.astype("<u4"), ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                blobs = [squeeze(_split(whole[x:y])) for x, y in zip(np.concatenate([[0], ends[:-1]]), ends)]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(counts + 1, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ROWS)


def _split(ids: np.ndarray) -> bytes:
    return ids.view(np.uint8).reshape(-1, 4).T.tobytes()


def _joined(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids can't have codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(object) if counts.sum() > 2**50 else counts[order].astype(np.int64)
    kept = []  # for each level, which of its merged items are single ids
    packs = np.empty(0, weights.dtype)
    for _ in range(limit):
        merged = np.concatenate([weights, packs])
        place = np.argsort(merged, kind="stable")
        kept.append(place < len(weights))
        ranked = merged[place]
        ranked = ranked[: len(ranked) // 2 * 2]
        packs = ranked[0::2] + ranked[1::2]
    take = 2 * (len(order) - 1)
    for single in reversed(kept):
        ids = int(single[:take].sum())
        out[order[:ids]] += 1
        take = 2 * (take - ids)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    code = last = 0
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded bits, most significant first, and the bit offset of every CHECKPOINT-th id."""
    sizes = lengths[ids]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    value = codes[ids].astype(np.uint64) << (np.uint64(64) - sizes.astype(np.uint64) - (begins & 31).astype(np.uint64))
    word = begins >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(value, first) if len(first) else value  # disjoint bits: the sum joins them
    words = np.zeros((total >> 5) + 3, np.uint64)
    at = word[first]
    words[at] += sums >> np.uint64(32)
    words[at + 1] += sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], begins[::CHECKPOINT]


class Table:
    """The decoder's table: for every LIMIT bits ahead, the id and the bits that it takes."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        codes = canonical(lengths)
        self.ids, self.bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
        self.limit = limit
        for i in np.flatnonzero(lengths).tolist():
            n = int(lengths[i])
            a = int(codes[i]) << (limit - n)
            self.ids[a : a + (1 << (limit - n))], self.bits[a : a + (1 << (limit - n))] = i, n

    def decode(self, raw: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        data = np.frombuffer(raw + bytes(CHECKPOINT * self.limit // 8 + 8), np.uint8).astype(np.uint32)
        ahead = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        at = checkpoints.astype(np.int64)
        out = np.empty((CHECKPOINT, len(at)), np.uint32)
        mask = np.uint32((1 << self.limit) - 1)
        for k in range(min(CHECKPOINT, n)):
            look = (ahead[at >> 3] >> (24 - self.limit - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.ids[look]
            at = at + self.bits[look]
        return out.T.ravel()[:n] if len(at) else out[:0].ravel()


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Write the ids of all documents to the folder `path` as coded blocks."""
    spark = docs.sparkSession
    token_rows(docs, tokenizer, end_id).write.mode("overwrite").parquet(f"{path}/ids")
    rows = spark.read.schema(ROWS).parquet(f"{path}/ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, total = zstandard.ZstdDecompressor().decompress, np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                got = np.bincount(_joined(expand(raw.as_py())))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    totals = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counts = np.zeros(max((r["id"] for r in totals), default=0) + 1, np.int64)
    for r in totals:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist())), "id long, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/book")
    book = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codes, sizes = book.value
        expand, part = zstandard.ZstdDecompressor().decompress, TaskContext.get().partitionId()
        keys, parts, before, number = [], [], 0, 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            bits, marks = pack_bits(ids, codes, sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (number, before, len(ids))), *(pa.array([x], pa.list_(pa.int64())) for x in (keys, [len(p) for p in parts])), pa.array([marks.astype("<i8").tobytes()], pa.binary()), pa.array([bits], pa.binary())],
                ["part", "block", "before", "n_ids", "doc_ids", "doc_tokens", "checkpoints", "bits"],
            )

        held = 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                parts.append(_joined(expand(raw.as_py())))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    before, number, keys, parts, held = before + held, number + 1, [], [], 0
        if parts:
            yield block()

    ordered = rows.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read a coded folder: doc_id, start (ids before it), n_tokens, ids_crc32 and ids (little-endian 32-bit numbers)."""
    ship(spark)
    book = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/book").collect()}  # the vocabulary at most
    lengths = np.zeros(max(book, default=0) + 1, np.int64)
    for i, n in book.items():
        lengths[i] = n
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    bases, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # as many rows as files
        bases[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((lengths, bases))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, base = shared.value
        table = Table(sizes)
        for batch in batches:
            for row in batch.to_pylist():
                ids = table.decode(row["bits"], np.frombuffer(row["checkpoints"], "<i8"), row["n_ids"]).astype("<u4")
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                raw = [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["part"]] + row["before"] + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def coded(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write documents to a folder of coded blocks and read them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/coded"
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
