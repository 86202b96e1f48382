"""Token ids of whole texts with public tokenizer files, vectorised over Arrow batches.

A batch is cut into chunks at white space where the tokenizer's own pre-tokenizer must cut as well, so
the ids of a text are the ids of its chunks in order. Each distinct chunk of a batch is encoded once
and the ids are gathered with numpy. Chunks of plain Latin letters go through the rank tables of the
same vocabulary; all others go through the tokenizers library itself. A bounded cache holds chunks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20
CACHE_WORDS = 250_000
#: A chunk longer than this is not kept in the cache.
CACHED_CHARS = 64

#: White space that the fast cutting of byte-level texts doesn't know, and the mark it cuts at.
ODD = "[\x00\x0b\x0c\r\t\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Control strings that the tokenizers take out of the text before anything else.
CONTROL = "<|"


class Encoder:
    """Ids for texts by one tokenizer file: `byte` (byte-level BPE) or `word` (BPE with word ends)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab = max(self.slow.get_vocab_size(), 1)
        self.dtype = np.uint16 if self.vocab <= 65536 else np.uint32
        self.word = model.get("end_of_word_suffix") == "</w>"
        end = b"\xff" if self.word else b""
        byte_of = _byte_alphabet()

        def raw(token: str) -> bytes:
            ends = self.word and token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if ends else token)) + (end if ends else b"")

        ranks = {bytes([b]): b for b in range(256)}
        if self.word:  # a word's last letter and its end are one symbol, joined before all merges
            ranks |= {bytes([b]) + end: 256 + b for b in range(255)}
        for merge in model["merges"]:
            pair = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw("".join(pair)), 512 + len(ranks))
        ranks = {k: n for n, (k, _) in enumerate(sorted(ranks.items(), key=lambda x: x[1]))}
        ids = {raw(token): i for token, i in model["vocab"].items() if not token.startswith(CONTROL)}
        self.id_of = [ids.get(k, 0) for k in ranks]
        self.end = end
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        if self.word:
            self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
            self.plain = regex.compile("[\x21-\x7e\u00c0-\u00ff]*").fullmatch
        else:
            self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
            self.plain = regex.compile("[\x20-\x7e\n\u00c0-\u00ff]*").fullmatch
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def chunk(self, text: str) -> bytes:
        """Ids of one chunk as little-endian numbers of this encoder's width."""
        if CONTROL in text or not self.plain(text):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            id_of, pieces, end = self.id_of, self.pieces, self.end
            ids = [id_of[r] for p in self.cut(text.lower() if self.word else text) for r in pieces(p.encode() + end)]
        return np.array(ids, self.dtype).tobytes()

    def chunks(self, words: list[str]) -> list[bytes]:
        out = []
        new, old = self.new, self.old
        for w in words:
            got = new.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    got = self.chunk(w)
                if len(w) <= CACHED_CHARS:
                    new[w] = got
                    if len(new) >= CACHE_WORDS:
                        self.old = old = new
                        self.new = new = {}
            out.append(got)
        return out

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, list[int]]:
        """Chunks of each text, and the positions of texts that must go whole through the tokenizer."""
        if self.word:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), []
        odd = pc.match_substring_regex(texts, ODD)
        whole: list[int] = []
        if pc.any(odd).as_py():
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
            texts = pc.if_else(odd, "", texts)
        runs = pc.match_substring_regex(texts, "[ \n][ \n]")
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
        if pc.any(runs).as_py():
            careful = pc.replace_substring_regex(pc.if_else(runs, texts, ""), r"(\S)([ \n]\S)", "\\1\x00\\2")
            cut = pc.if_else(runs, careful, cut)
        return pc.split_pattern(cut, "\x00"), whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's count."""
        lists, whole = self._cut(texts)
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = self.chunks(coded.dictionary.to_pylist())
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // width
        pool = np.frombuffer(b"".join(words), self.dtype)
        begins = np.cumsum(sizes) - sizes
        counts = sizes[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((begins[index] - (ends - counts)).astype(np.int32 if max(total, len(pool)) < 2**31 else np.int64), counts)
        at += np.arange(total, dtype=at.dtype)
        ids = pool[at]
        offsets = lists.offsets.to_numpy()
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        if whole:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for k in whole:
                parts[k] = np.array(self.slow.encode(texts[k].as_py(), add_special_tokens=False).ids, self.dtype)
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.diff(bounds)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file at path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about `most` bytes (one text at least)."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null: empty)."""
    got = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(got.cast(pa.string()) if got.type != pa.string() else got, "")


def _byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
