"""Fill-in-the-middle: texts cut at two token boundaries, which rank and select over packed bits find.

The bytes of a slice of texts give one bit for each place where a token (`[A-Za-z]+|[^A-Za-z]`) begins and
one for each place where a character begins. Bits are packed to 64-bit words; a directory holds the ones
before each block of 512 bits. Ranks at the ends of a text count its tokens, select on a rank is the byte of
a cut, and ranks of the other vector count the characters on either side of it. Nothing is tokenized.

Defined cases: null text is empty; empty texts and texts that hold a mark stay as they are (form plain); a
null key draws as the empty string; equal keys draw the same numbers, and repeated rows all stay; an empty
table gives no rows; extra columns stay out of the result. A slice of about SLICE_BYTES, or one longer text,
is in a worker's memory with its bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column, slices
from lumenspan.session import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
BLOCK = 8

#: What a byte is: a letter of a longer token, the first byte of another character, a later byte of one.
LETTER, SINGLE, LATER = 0, 1, 2
KINDS = np.full(256, SINGLE, np.uint8)
KINDS[0x80:0xC0] = LATER
KINDS[ord("A") : ord("Z") + 1] = KINDS[ord("a") : ord("z") + 1] = LETTER


class Bits:
    """Packed bits that answer rank (ones before a place) and select (place of a one) for arrays of questions."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        blocks = len(packed) // (8 * BLOCK) + 1  # one word past the end at least, so that rank can ask there
        self.words = np.concatenate([packed, np.zeros(blocks * 8 * BLOCK - len(packed), np.uint8)]).view(np.uint64)
        self.counts = np.bitwise_count(self.words).astype(np.int64).reshape(-1, BLOCK)
        self.before = np.concatenate([[0], np.cumsum(self.counts.sum(1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        block, inside = word // BLOCK, word % BLOCK
        whole = np.where(np.arange(BLOCK) < inside[:, None], self.counts[block], 0).sum(1)
        rest = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(rest)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it; there must be such a one."""
        block = np.searchsorted(self.before, k, "right") - 1
        upto = np.cumsum(self.counts[block], axis=1)
        rest = k - self.before[block]
        inside = (upto <= rest[:, None]).sum(1)
        rest = rest - np.where(inside > 0, np.take_along_axis(upto, np.maximum(inside - 1, 0)[:, None], 1)[:, 0], 0)
        word = block * BLOCK + inside
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(bits, axis=1) <= rest[:, None]).sum(1)


def boundaries(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[Bits, Bits]:
    """Where tokens and where characters begin, for texts that lie one behind the other in data."""
    kinds = KINDS[data]
    token = kinds == SINGLE
    letter = kinds == LETTER
    token[1:] |= letter[1:] & ~letter[:-1]
    token[begins[ends > begins]] = True  # a text's first letter, whatever ends the text before
    return Bits(token), Bits(kinds != LATER)


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text: n, the byte cuts (from the text's first byte) and the characters before each, by two draws."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    base, buffer = ends[0], texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[base : ends[-1]] if buffer is not None else np.empty(0, np.uint8)
    begins, ends = ends[:-1] - base, ends[1:] - base
    token, char = boundaries(data, begins, ends)
    low = token.rank(begins)
    n = token.rank(ends) - low
    drawn = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    places = []
    for k in drawn:
        at, inner = ends.copy(), k < n
        at[inner] = token.select((low + k)[inner])
        places.append(at)
    chars = [char.rank(at) - char.rank(begins) for at in places]
    return n, places[0] - begins, places[1] - begins, chars[0], chars[1]


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits: the first hex digits of the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Rows of key, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output.

    `rate` of 100 texts are transformed, `spm` of 100 of those with the suffix first.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(mark)
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(key).alias("_key"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for a, b in slices(texts):
                part, some = texts.slice(a, b - a), batch.slice(a, b - a)
                n, low, high, before, upto = cuts(part, *(some.column(k).to_numpy() for k in (2, 3)))
                out = []
                for form, text, x, y in zip(some.column(4).to_pylist(), part, low.tolist(), high.tolist()):
                    if form == "plain":
                        out.append(text.as_py())
                        continue
                    raw = text.as_buffer().to_pybytes()
                    prefix, middle, suffix = (f"{mark}{piece.decode()}" for mark, piece in ((PREFIX, raw[:x]), (MIDDLE, raw[x:y]), (SUFFIX, raw[y:])))
                    out.append(prefix + suffix + middle if form == "psm" else suffix + prefix + middle)
                plain = np.array([f == "plain" for f in some.column(4).to_pylist()], bool)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), some.column(4).cast(pa.string()), pa.array(before, pa.int64(), mask=plain), pa.array(upto - before, pa.int64(), mask=plain), pa.array(out, pa.string())],
                    ["_key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(cut, f"_key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: pieces between the marks, which no cut text holds."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """transformed() with the hash of each output and of the text rebuilt from it, in place of the output."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return rows.withColumns({"output_sha256": digest(F.col("output")), "restored_sha256": digest(back)}).drop("output")
