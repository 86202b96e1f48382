"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as a whole, `<|im_start|>role<|im_sep|>text<|im_end|>` for each turn, and
encoded once with offsets; the three marks are single tokens, so no token straddles a turn. The spans of
the turns to learn are intersected with the sorted token spans by binary search.

Inside roles and texts `<` followed by any `!` and `|` gets one `!` more, which is undone on reading, so
no text can hold a mark.

Defined cases: null text and null role are empty; turns are ordered by (turn, role, text), null turns
first, so repeated and tied rows all stay; null conv_id is a conversation of its own; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.tokens import tokenizer_path
from lumenspan.session import ship

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SCHEMA = "conv_id long, text string, ids array<int>, token_begins array<int>, token_ends array<int>, mask array<boolean>, loss_begins array<int>, loss_ends array<int>"


def escaped(text: str) -> str:
    return re.sub(r"<(!*)\|", r"<!\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<!(!*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], learn: tuple[str, ...] = ("assistant",)) -> tuple[str, list[int], list[int]]:
    """The conversation's text, and begins and ends of the texts to learn."""
    out, begins, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        out += [head, body, END]
        at += len(head)
        if role in learn:
            begins.append(at)
            ends.append(at + len(body))
        at += len(body) + len(END)
    return "".join(out), begins, ends


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the rendered text."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.removesuffix(END).partition(SEP)
        out.append((unescaped(role), unescaped(body)))
    return out


def mask_of(token_begins: np.ndarray, token_ends: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: spans are sorted and apart, and so are tokens (those of one character share its span)."""
    mask = np.zeros(len(token_begins), bool)
    if not len(begins) or not len(mask):
        return mask
    span = np.searchsorted(begins, token_begins, "right") - 1
    inside = span >= 0
    mask[inside] = (token_ends[inside] <= ends[span[inside]]) & (token_begins[inside] < ends[span[inside]])
    return mask


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The tokenizer with the three marks as tokens of their own, after its vocabulary."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer

        out = Tokenizer.from_file(path)
        out.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (START, SEP, END)])
        _TOKENIZERS[path] = out
    return _TOKENIZERS[path]


def formatted(conversations: DataFrame, path: str | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: text, ids, token spans, mask, and the spans to learn (in characters)."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        held: list[tuple] = []

        def row(conv, turns) -> tuple:
            text, begins, ends = render(turns, learn)
            got = encode(text, add_special_tokens=False)
            spans = np.array(got.offsets, np.int32).reshape(-1, 2)
            mask = mask_of(spans[:, 0], spans[:, 1], np.array(begins), np.array(ends))
            return conv, text, got.ids, spans[:, 0].tolist(), spans[:, 1].tolist(), mask.tolist(), begins, ends

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()), *[pa.list_(pa.int32())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate(types)], [x.split()[0] for x in SCHEMA.split(", ")])

        now, turns, size, begun = None, [], 0, False
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if begun and conv != now:
                    held.append(row(now, turns))
                    size += len(held[-1][1])
                    turns = []
                    if size > 1 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                now, begun = conv, True
                turns.append((role, text))
        if begun:
            held.append(row(now, turns))
        if held:
            yield batch_of(held)

    return rows.mapInArrow(write, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """What formatted() wrote, read back: turns and the text under the mask, counted and hashed."""
    ship(chats.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, begins, ends, mask in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                turns = parse(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss, at = [], -1
                run = 0
                for begin, end, under in zip(begins, ends, mask):
                    if not under:
                        continue
                    if begin > at:  # a new span
                        if at >= 0:
                            loss.append(text[run:at])
                        run = begin
                    at = max(at, end)
                if at >= 0:
                    loss.append(text[run:at])
                learnt = "".join(unescaped(x) for x in loss)
                out.append((conv, len(turns), whole, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
