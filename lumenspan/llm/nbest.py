"""N-best segmentation into pieces, and decoding.

The lattice of a text has a node at each character and an arc for each piece of the model file that the
text spells there; a character without a piece is one arc of its byte pieces. A forward Viterbi pass gives
each node the best score of any way to it. A backward search from the end then pops partial paths in the
order of (score so far + that best score); as the estimate is exact, complete paths come out best first.

No piece crosses from a character to a following space mark, nor holds a line end, so the lattice is a
chain of segments. One forward pass for each distinct segment of a batch gives its best path and what the
second one loses. A segmentation that differs in a segment loses at least that, so of the n best only the
n - 1 segments that lose least can differ: their part of the lattice is searched, the rest keeps its best path.

Scores are those of the model file. Paths of equal score come in the order of the search, which depends
on the text alone.

Defined cases: null and empty texts have one segmentation, without pieces; fewer than n paths give fewer;
rows with equal ids each get a row; an empty table gives no rows; extra columns are ignored. A batch of
about SLICE bytes, or one longer text, is in a worker's memory at once.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column, slices, tokenizer_path
from lumenspan.session import ship

SPACE = "▁"
#: A byte that stands for a character without a piece costs this much.
BYTE_SCORE = -40_000.0
CACHE = 300_000
#: Lattices of short segments that are kept.
NEAR = 5_000
SLICE = 4 << 20
SCHEMA = "doc_id long, n_best int, scores array<double>, ids array<binary>"


class Lattice:
    """Nodes at the characters of some text, the arcs into each, and the best score of any way to it."""

    __slots__ = ("arcs", "best")

    def __init__(self, arcs: list[list[tuple[int, float, tuple]]], best: list[float]):
        self.arcs, self.best = arcs, best

    def search(self, n: int) -> list[tuple[float, list[tuple[int, tuple]]]]:
        """The n best paths as (score, [(node where an arc begins, its ids)]), by backward A*.

        Partial paths from the end are popped in the order of (score so far + best score to where they stand).
        """
        arcs, best = self.arcs, self.best
        push, pop = heapq.heappush, heapq.heappop
        found: list[tuple[float, list]] = []
        heap: list[tuple] = [(-best[-1], 0, len(best) - 1, 0.0, None)]
        count = 0
        while heap and len(found) < n:
            total, _, at, after, path = pop(heap)
            # the arc that keeps the estimate would be popped next, so it is followed at once
            while at:
                now, on = best[at], None
                for begin, score, ids in arcs[at]:
                    value = score + best[begin]
                    if on is None and value == now:
                        on = begin, score, ids
                    else:
                        count += 1
                        push(heap, (-(after + value), count, begin, after + score, (begin, ids, path)))
                at, score, ids = on
                after += score
                path = (at, ids, path)
            steps = []
            while path:
                steps.append(path[:2])
                path = path[2]
            found.append((-total, steps))
        return found


def joined(lattices: list[Lattice]) -> Lattice:
    """The lattice of texts one after another, where no piece crosses from one to the next."""
    if len(lattices) == 1:
        return lattices[0]
    arcs, best = [[]], [0.0]
    for part in lattices:
        at, score = len(best) - 1, best[-1]
        arcs += [[(at + begin, s, ids) for begin, s, ids in into] for into in part.arcs[1:]]
        best += [score + b for b in part.best[1:]]
    # sums are taken anew along the arcs, so that a best arc keeps the estimate to the last bit
    for node in range(1, len(best)):
        best[node] = max(s + best[begin] for begin, s, _ in arcs[node])
    return Lattice(arcs, best)


class Pieces:
    """A piece model: lattices, segments and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.pieces: dict[str, tuple[float, tuple]] = {}
        self.byte_ids = [0] * 256
        self.dtype = np.uint16 if n <= 65536 else np.uint32
        # a node of the trie is [what follows by character, (score, ids) of the piece that ends here]
        self.trie: list = [{}, None]
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                self.pieces[piece] = (model.get_score(i), (i,))
                node = self.trie
                for c in piece:
                    node = node[0].setdefault(c, [{}, None])
                node[1] = self.pieces[piece]
        self.new: dict[str, tuple[float, tuple, float]] = {}
        self.old: dict[str, tuple[float, tuple, float]] = {}
        self.near: dict[str, Lattice] = {}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces that cross words or lines need longer segments")

    def bytes_arc(self, character: str) -> tuple[float, tuple]:
        """Score and ids of a character that no piece spells."""
        ids = tuple(self.byte_ids[b] for b in character.encode())
        return BYTE_SCORE * len(ids), ids

    def lattice(self, text: str) -> Lattice:
        """The lattice of a segment; those of short segments are kept, for words that lose little come up often."""
        got = self.near.get(text)
        if got is not None:
            return got
        n = len(text)
        arcs: list[list[tuple[int, float, tuple]]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-1e300] * n
        for i in range(n):
            here, node = best[i], self.trie
            for j in range(i, n):
                node = node[0].get(text[j])
                if node is None:
                    break
                if node[1]:
                    score, ids = node[1]
                    arcs[j + 1].append((i, score, ids))
                    best[j + 1] = max(best[j + 1], here + score)
            if not arcs[i + 1] or arcs[i + 1][-1][0] != i:
                score, ids = self.bytes_arc(text[i])
                arcs[i + 1].append((i, score, ids))
                best[i + 1] = max(best[i + 1], here + score)
        got = Lattice(arcs, best)
        if n <= 40:
            if len(self.near) >= NEAR:
                self.near = {}
            self.near[text] = got
        return got

    def viterbi(self, text: str) -> tuple[float, tuple, float]:
        """Score and ids of a segment's best path, and what its second one loses (infinite without one), in one forward pass."""
        n = len(text)
        none = -1e300
        best, second = [0.0] + [none] * n, [none] * (n + 1)
        back: list = [None] * (n + 1)
        trie = self.trie[0]
        for i in range(n):
            here, other, step = best[i], second[i], trie
            single = False
            for j in range(i + 1, n + 1):
                node = step.get(text[j - 1])
                if node is None:
                    break
                step, piece = node
                if piece:
                    value = here + piece[0]
                    if value > best[j]:
                        second[j] = max(best[j], other + piece[0])
                        best[j] = value
                        back[j] = i, piece[1]
                    elif value > second[j]:
                        second[j] = value
                    if j == i + 1:
                        single = True
            if not single:
                score, ids = self.bytes_arc(text[i])
                value = here + score
                if value > best[i + 1]:
                    second[i + 1] = max(best[i + 1], other + score)
                    best[i + 1] = value
                    back[i + 1] = i, ids
                elif value > second[i + 1]:
                    second[i + 1] = value
        ids, at = [], n
        while at:
            at, piece = back[at]
            ids.append(piece)
        return best[n], tuple(i for piece in reversed(ids) for i in piece), best[n] - second[n] if second[n] > 0.5 * none else float("inf")

    def summary(self, segment: str) -> tuple[float, tuple, float]:
        """viterbi() of a segment; short segments are kept."""
        got = self.new.get(segment)
        if got is None:
            got = self.old.get(segment)
            if got is None:
                got = self.viterbi(segment)
            if len(segment) <= 40:
                self.new[segment] = got
                if len(self.new) >= CACHE:
                    self.old, self.new = self.new, {}
        return got

    def n_best(self, segments: list[str], losses: np.ndarray, n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """The n best segmentations of a chain of segments: (what each loses, {segment: its ids} where they may differ).

        A segmentation that changes a segment loses at least that segment's loss, so only the n - 1 segments
        that lose least can differ in the n best; A* searches the lattice of these, all others keep their best path.
        """
        few = n - 1
        near = np.argsort(losses, kind="stable")[:few] if len(losses) < 64 or not few else np.sort(np.argpartition(losses, few - 1)[:few])
        near = sorted(int(k) for k in near if np.isfinite(losses[k]))
        if not near:
            return [(0.0, {})]
        lattice = joined([self.lattice(segments[k]) for k in near])
        ends = np.cumsum([len(segments[k]) for k in near]).tolist()
        out = []
        for score, steps in lattice.search(n):
            ids: list[list[int]] = [[] for _ in near]
            place = 0
            for begin, piece in steps:
                while begin >= ends[place]:
                    place += 1
                ids[place] += piece
            out.append((lattice.best[-1] - score, dict(zip(near, ids))))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a text from its ids."""
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


def segments(texts: pa.Array) -> pa.ListArray:
    """Segments of each text: a run of space marks with what follows it, and line ends by themselves."""
    marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), "")
    marked = pc.if_else(pc.equal(texts, ""), "", marked)
    lines = pc.replace_substring(marked, "\n", "\x00\n\x00")
    runs = pc.match_substring(lines, SPACE + SPACE)
    cut = pc.replace_substring(lines, SPACE, "\x00" + SPACE)
    if pc.any(runs).as_py():
        careful = pc.replace_substring_regex(pc.if_else(runs, lines, ""), f"({SPACE}+)", "\x00\\1")
        cut = pc.if_else(runs, careful, cut)
    return pc.split_pattern(cut, "\x00")


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode_batch(pieces: Pieces, texts: pa.Array, n: int) -> tuple[list[list[float]], list[list[np.ndarray]]]:
    """For each text the scores and ids of its n best segmentations."""
    lists = segments(pc.if_else(pc.match_substring(texts, "\x00"), "", texts))
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    first = [pieces.summary(s) for s in names]
    score = np.array([f[0] for f in first])
    gap = np.array([f[2] for f in first])
    sizes = np.array([len(f[1]) for f in first], np.int64)
    pool = np.fromiter((i for f in first for i in f[1]), pieces.dtype, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    counts = sizes[index]
    ends = np.cumsum(counts)
    flat = pool[np.repeat(begins[index] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    starts = np.concatenate([[0], ends])
    scores, ids = [], []
    for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        text = texts[t].as_py() if b - a < 2 else None
        if text is not None and "\x00" in text:  # the mark of the cuts is in the text, so it is cut by hand
            parts = [s for s in re.split(f"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)", SPACE + text.replace(" ", SPACE)) if s]
            ways = [pieces.summary(s) for s in parts]
            own = np.fromiter((i for w in ways for i in w[1]), pieces.dtype)
            at = np.cumsum([0, *(len(w[1]) for w in ways)])
            base, best = sum(w[0] for w in ways), pieces.n_best(parts, np.array([w[2] for w in ways]), n)
        else:
            own = flat[starts[a] : starts[b]]
            at = starts[a : b + 1] - starts[a]
            few = index[a:b]
            base, best = float(score[few].sum()), pieces.n_best(_Names(names, few), gap[few], n)
        scores.append([base - loss for loss, _ in best])
        versions = [own]
        for _, changed in best[1:]:
            parts, done = [], 0
            for k, other in changed.items():
                parts += [own[done : at[k]], np.array(other, pieces.dtype)]
                done = at[k + 1]
            versions.append(np.concatenate([*parts, own[done:]]))
        ids.append(versions)
    return scores, ids


class _Names:
    """Segments of one text, looked up as they are asked for."""

    def __init__(self, names: list[str], index: np.ndarray):
        self.names, self.index = names, index

    def __getitem__(self, k: int) -> str:
        return self.names[self.index[k]]


def segmentations(docs: DataFrame, n: int = 3, path: str | None = None) -> DataFrame:
    """doc_id, n_best, scores and ids (little-endian 32-bit numbers) of the n best segmentations of every whole text."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(0)
            for a, b in slices(texts, SLICE):
                scores, ids = encode_batch(pieces, texts.slice(a, b - a), n)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array([len(s) for s in scores], pa.int32()), pa.array(scores, pa.list_(pa.float64())), pa.array([[x.astype("<u4").tobytes() for x in v] for v in ids], pa.list_(pa.binary()))],
                    ["doc_id", "n_best", "scores", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SCHEMA)


def digests(docs: DataFrame, n: int = 3, path: str | None = None) -> DataFrame:
    """The segmentations of every whole text, in numbers: pieces of the best, scores of all, CRC32 of each one's ids, CRC32 of the text that the best decodes to, and whether all decode to it.

    Ids are digested where they are made, since they are larger than the texts. Ids that two segmentations
    share at their beginning and end decode alike, so what differs in between decides.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(0)
            for a, b in slices(texts, SLICE):
                scores, ids = encode_batch(pieces, texts.slice(a, b - a), n)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array([len(v[0]) for v in ids], pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array([[zlib.crc32(x.astype("<u4").tobytes()) for x in v] for v in ids], pa.list_(pa.int64())),
                     pa.array([zlib.crc32(pieces.decode(v[0])) for v in ids], pa.int64()), pa.array([all(_decode_alike(pieces, v[0], x) for x in v[1:]) for v in ids])],
                    ["doc_id", "n_pieces", "scores", "ids_crc32", "text_crc32", "all_decode"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, n_pieces long, scores array<double>, ids_crc32 array<long>, text_crc32 long, all_decode boolean")


def _decode_alike(pieces: Pieces, one: np.ndarray, two: np.ndarray) -> bool:
    n = min(len(one), len(two))
    differ = np.flatnonzero(one[:n] != two[:n])
    first = int(differ[0]) if len(differ) else n
    back = np.flatnonzero(one[::-1][: n - first] != two[::-1][: n - first])
    last = int(back[0]) if len(back) else n - first
    raw = [b"".join(map(pieces.bytes_of.__getitem__, x[first : len(x) - last].tolist())) for x in (one, two)]
    return raw[0] == raw[1]
