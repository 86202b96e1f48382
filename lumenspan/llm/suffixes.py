"""Removal of repeated byte strings with sparse suffix sorting.

Every window of LENGTH bytes is represented by an anchor inside it: the position of its least-hashed
GRAM bytes, so equal windows have equal anchors at equal distance, and one suffix in about 35 has to be
sorted. Anchors are dealt by hash. Where all anchors of a hash have one and the same surroundings, the
first keeps its windows and the others lose theirs. Where surroundings differ, their suffixes (to the
right) and reversed prefixes (to the left) are ordered by deep-shallow sorting: multikey quicksort to
SHALLOW bytes, then blind tries for the groups that still agree. Common-prefix lengths along both orders
tell, for every distance of a window from its anchor, which windows are equal; the first one stays.

A common passage doesn't gather in one place: anchors with equal surroundings are reduced to the first of each
BATCH_BYTES of text before they are sent; hashes that gather over HOT_ANCHORS different surroundings leave the
bucket as they come and are dealt once more, by whole window, and of equal windows (compared byte by byte)
only the first of each CHUNK records is sent.

That two surroundings are equal is told by two 64-bit hashes of them (the gram, and the 168 bytes around it);
their bytes are only compared where hashes of surroundings differ: sending all of them would take more disk
than the text.

Defined cases: null text is empty; documents with null ids come last and, like documents with equal ids,
are taken in order of their text; texts under LENGTH bytes lose nothing; an empty table gives no rows;
extra columns are ignored by `spans`, and kept by `without_repeats`; a worker holds one text whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column, slices
from lumenspan.session import release, ship, stored

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM  # the farthest that a window begins before its anchor
SHALLOW = 48
HOT_ANCHORS = 20_000
#: Anchors of a bucket after which hot hashes leave it, and records of windows that are compared before they are sent.
HELD_ANCHORS, CHUNK = 400_000, 60_000
BLOCK = 512
#: No byte of UTF-8 text.
GAP = b"\xff" * LENGTH
#: Bytes of text whose anchors are compared before they are sent.
BATCH_BYTES = 24 << 20
PACKED = "block long, kind int, key long, data binary"
SPANS, ANCHORS, TEXTS = 0, 1, 2

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x = x * _U(by)
    return x ^ (x >> _U(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all GRAM-byte strings, doubling the width."""
    h, width, base = data.astype(np.uint64), 1, _BASE
    while width < GRAM:
        up = h[:-width] * _U(base)
        up += h[width:]
        h, width, base = up, 2 * width, base * base & (2**64 - 1)
    return h


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    now = 1
    while 2 * now <= width:
        x = best(x[:-now], x[now:])
        now *= 2
    return best(x[: len(x) - (width - now)], x[width - now :]) if width > now else x


def anchors(data: np.ndarray, valid: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, ...]:
    """Anchor positions, hashes, hashes of their surroundings, and the first and last window start of each.

    data begins and ends with GAP; valid marks the starts of windows that lie inside one document.
    """
    out: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    back = np.arange(REACH, -1, -1)
    for a in range(LENGTH, n - LENGTH, step):
        b = min(a + step, n - LENGTH)
        low = a - REACH
        raw = gram_hashes(data[low : min(n, b + REACH + 2 * GRAM + 8)])
        h = _mix(raw, 0xD6E8FEB86659FD93) | _U(1)
        least = _sliding(h, REACH + 1, np.minimum)[: b - low]  # by window start
        least = least * valid[low : low + len(least)]
        most = _sliding(least, REACH + 1, np.maximum)  # over the windows that hold a position
        at = np.flatnonzero(most[: b - a] == h[REACH : REACH + b - a][: len(most)])
        if not len(at):
            continue
        own = h[at + REACH]
        inside = least[(at[:, None] + REACH) - back[None, :]] == own[:, None]
        first = inside.argmax(axis=1)
        count = inside.sum(axis=1)
        around = np.zeros(len(at), np.uint64)
        for k in (0, 32, REACH - 32, REACH, REACH + 32, REACH + 64, REACH + LENGTH - GRAM):
            around = _mix(around + raw[at + k], 0xA0761D6478BD642F)
        p = at + a
        out.append((p, own, around, p - REACH + first, p - REACH + first + count - 1))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of (sorted) keys begins."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each document."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    starts = np.flatnonzero(_groups(doc))
    width = int(end.max()) + 1
    number = np.repeat(np.arange(len(starts)), np.diff([*starts, len(doc)]))
    reach = np.maximum.accumulate(end + number * width)  # later documents start higher
    new = np.ones(len(doc), bool)
    new[1:] = (begin[1:] + number[1:] * width) > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], begin[first], reach[last] - number[last] * width


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes, each split into byte planes (near-equal bytes lie together)."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(sizes), 0, []
    for t, size in zip(types, sizes):
        part = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(np.ascontiguousarray(part).view(t).ravel())
        at += n * size
    return out


ANCHOR_TYPES = ("<u8", "<u8", "<i8", "<u4", "u1", "u1")
SPAN_TYPES = ("<i8", "<u4", "<u4")
POINT_TYPES = ("<u8", "<i8", "<u4", "u1", "u1", "u1")
AROUND = REACH + LENGTH
RECORD_TYPES = ("<u8", "<i8", "<u4", "u1", "u1", f"V{AROUND}")


def _rows(kind: int, blocks: np.ndarray, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """One row for each block that occurs."""
    order = np.argsort(blocks, kind="stable")
    blocks, columns = blocks[order], [c[order] for c in columns]
    cuts = np.flatnonzero(_groups(blocks))
    ends = np.append(cuts[1:], len(blocks))
    data = [_pack(*(c[a:b] for c in columns)) for a, b in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks[cuts].astype(np.int64)), pa.array(np.full(len(cuts), kind, np.int32)), pa.array(np.zeros(len(cuts), np.int64)), pa.array(data, pa.binary())], ["block", "kind", "key", "data"]
    )


def _span_rows(doc, begin, end) -> pa.RecordBatch:
    doc, begin, end = merged(doc, begin, end)
    return _rows(SPANS, doc // BLOCK, (doc.astype("<i8"), begin.astype("<u4"), end.astype("<u4")))


def _first_pass(buckets: int):
    """Texts to anchors by bucket of their hash (kind ANCHORS); repeats inside the batch become spans at once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = column(batch, "text").cast(pa.binary()), batch.column(0).to_numpy()
            for x, y in slices(texts, BATCH_BYTES):
                raw = [t.as_py() for t in texts.slice(x, y - x)]
                data = np.frombuffer(GAP + GAP.join(raw) + GAP, np.uint8)
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                starts = np.cumsum(sizes + LENGTH) - sizes
                edge = np.zeros(len(data) + 1, np.int8)
                long = sizes >= LENGTH
                edge[starts[long]] += 1
                edge[(starts + sizes - LENGTH + 1)[long]] -= 1
                p, h, around, low, high = anchors(data, np.cumsum(edge, dtype=np.int8)[:-1].astype(np.uint64))
                row = np.searchsorted(starts, p, "right") - 1
                doc, pos = keys[x:y][row], p - starts[row]
                back, fore = (p - low).astype("u1"), (p - high).astype("u1")
                order = np.lexsort((pos, doc, around, h))
                h, around, doc, pos, back, fore = (c[order] for c in (h, around, doc, pos, back, fore))
                new = _groups(h, around)
                old = ~new
                if old.any():
                    yield _span_rows(doc[old], pos[old] - back[old], pos[old] - fore[old] + LENGTH)
                h, around, doc, pos, back, fore = (c[new] for c in (h, around, doc, pos, back, fore))
                if len(h):
                    yield _rows(ANCHORS, ((h >> _U(20)) % _U(buckets)).astype(np.int64), (h, around, doc.astype("<i8"), pos.astype("<u4"), back, fore))

    return scan


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """(block, its rows) of batches that are sorted by block."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for block, some in groupby(rows, key=lambda r: r[0]):
        yield block, ((r[1], r[2], r[3]) for r in some)


def _second_pass(hot_anchors: int, most: int):
    """Anchors of a bucket: spans where all surroundings are equal, points (by document block) where they differ.

    Not more than about `most` anchors of a bucket are held; hashes with over `hot_anchors` different
    surroundings become hot points at once, as do all their later anchors.
    """

    def points(h, doc, pos, back, fore, hot: int) -> pa.RecordBatch:
        return _rows(ANCHORS, doc // BLOCK, (h, doc, pos.astype("<u4"), back, fore, np.full(len(h), hot, "u1")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches):
            held: list[list[np.ndarray]] = []
            hot, count, limit = np.zeros(0, np.uint64), 0, most

            def reduced() -> Iterator[pa.RecordBatch]:
                """Spans of anchors with surroundings seen before, and points of hot hashes; the others stay held."""
                nonlocal held, hot, count, limit
                h, around, doc, pos, back, fore = (np.concatenate(c) for c in zip(*held))
                order = np.lexsort((pos, doc, around, h))
                h, around, doc, pos, back, fore = (c[order] for c in (h, around, doc, pos, back, fore))
                new = _groups(h, around)
                if not new.all():
                    old = ~new
                    yield _span_rows(doc[old], pos[old].astype(np.int64) - back[old], pos[old].astype(np.int64) - fore[old] + LENGTH)
                kept = [c[new] for c in (h, around, doc, pos, back, fore)]
                values, sizes = np.unique(kept[0], return_counts=True)
                hot = np.union1d(hot, values[sizes > hot_anchors])
                out = np.isin(kept[0], hot)
                if out.any():
                    yield points(*(kept[k][out] for k in (0, 2, 3, 4, 5)), 1)
                held = [[c[~out] for c in kept]]
                count = len(held[0][0])
                limit = max(most, 2 * count)

            for kind, _, raw in rows:
                if kind == ANCHORS:
                    held.append(_unpack(raw, *ANCHOR_TYPES))
                    count += len(held[-1][0])
                    if count > limit:
                        yield from reduced()
            if not held:
                continue
            yield from reduced()
            h, _, doc, pos, back, fore = held[0]
            sizes = np.diff(np.append(np.flatnonzero(_groups(h)), len(h)))
            some = np.repeat(sizes, sizes) > 1
            if some.any():
                yield points(*(c[some] for c in (h, doc, pos, back, fore)), 0)

    return judge


def _third_pass(buckets: int, chunk: int):
    """Points and texts of a document block to records with their surroundings, by bucket of their hash."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        held: list[list[np.ndarray]] = []
        count = 0

        def emit() -> Iterator[pa.RecordBatch]:
            h, doc, pos, back, fore, around = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((pos, doc, h))
            h, doc, pos, back, fore, around = (c[order] for c in (h, doc, pos, back, fore, around))
            alone = np.flatnonzero((back == 0) & (fore == 0))  # records of one window: of equal ones the first is enough
            if len(alone):
                window = np.concatenate([h[alone].view(np.uint8).reshape(-1, 8), around[alone].view(np.uint8).reshape(-1, AROUND)[:, REACH : REACH + LENGTH]], axis=1)
                _, first, number = np.unique(np.ascontiguousarray(window).view(f"V{8 + LENGTH}").ravel(), return_index=True, return_inverse=True)
                again = np.ones(len(alone), bool)
                again[_earliest(number, doc[alone], pos[alone], len(first))] = False
                if again.any():
                    gone = alone[again]
                    yield _span_rows(doc[gone], pos[gone], pos[gone] + LENGTH)
                    stay = np.ones(len(h), bool)
                    stay[gone] = False
                    h, doc, pos, back, fore, around = (c[stay] for c in (h, doc, pos, back, fore, around))
            yield _rows(ANCHORS, ((h >> _U(20)) % _U(buckets)).astype(np.int64), (h, doc, pos.astype("<u4"), back, fore, around))

        for _, rows in _by_block(batches):
            points: list[list[np.ndarray]] = []
            table = None
            for kind, key, raw in rows:
                if kind == ANCHORS:
                    points.append(_unpack(raw, *POINT_TYPES))
                    continue
                if not points:
                    break  # nothing to look up in this block
                if table is None:
                    table = [np.concatenate(c) for c in zip(*points)]
                    order = np.argsort(table[1], kind="stable")
                    table = [c[order] for c in table]
                a, b = np.searchsorted(table[1], [key, key + 1])
                if a == b:
                    continue
                h, doc, pos, back, fore, hot = (c[a:b] for c in table)
                data = np.frombuffer(GAP + expand(raw) + GAP, np.uint8)
                pos = pos.astype(np.int64)
                if hot.any():
                    h, doc, pos, back, fore = _by_window(data, h, doc, pos, back, fore, hot.astype(bool))
                around = data[(pos + LENGTH - REACH)[:, None] + np.arange(AROUND)[None, :]]
                held.append([h, doc, pos, back, fore, np.ascontiguousarray(around).view(f"V{AROUND}").ravel()])
                count += len(h)
                if count >= chunk:
                    yield from emit()
                    held, count = [], 0
        if held:
            yield from emit()

    return gather


def _earliest(number: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """The row with the least (doc, pos) of each number under n."""
    order = np.lexsort((pos, doc, number))
    return order[np.searchsorted(number[order], np.arange(n))]


def _by_window(data, h, doc, pos, back, fore, hot):
    """Points of hot hashes, one for each of their windows: the window's start is the anchor, its hash the key."""
    widths = back[hot].astype(np.int64) - fore[hot] + 1
    start = np.repeat(pos[hot] - back[hot], widths) + np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
    start = np.unique(start)
    raw = gram_hashes(data)
    key = np.zeros(len(start), np.uint64)
    for k in (0, 32, 64, LENGTH - GRAM):
        key = _mix(key + raw[start + LENGTH + k], 0xE7037ED1A0B428DB)
    zero = np.zeros(len(start), "u1")
    cool = ~hot
    return (np.concatenate(x) for x in ((h[cool], key), (doc[cool], np.full(len(start), doc[0])), (pos[cool], start), (back[cool], zero), (fore[cool], zero)))


def deep_shallow(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-width byte rows inside their groups, and each row's common prefix with the row before it.

    Rows are split by multikey quicksort, eight bytes at a time, down to SHALLOW bytes; those that still
    agree are ordered by a blind trie. The prefix is -1 for the first row of a group.
    """
    n, width = strings.shape
    order = np.lexsort((group,))
    part = np.cumsum(_groups(group[order])) - 1  # rows in one part agree so far
    for at in range(0, min(SHALLOW, width), 8):
        sizes = np.bincount(part)
        open_ = np.flatnonzero(sizes[part] > 1)
        if not len(open_):
            break
        digit = _words(strings[order[open_], at : at + 8])
        inner = np.lexsort((digit, part[open_]))
        order[open_] = order[open_][inner]
        digit, same = digit[inner], part[open_]
        new = np.ones(n, bool)
        new[1:] = part[1:] != part[:-1]
        new[open_[1:]] |= (digit[1:] != digit[:-1]) & (same[1:] == same[:-1])
        part = np.cumsum(new) - 1
    if width > SHALLOW and n:
        cuts = np.flatnonzero(_groups(part))
        sizes = np.diff(np.append(cuts, n))
        for a, size in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            rows = order[a : a + size]
            order[a : a + size] = rows[blind_trie([strings[r].tobytes() for r in rows], SHALLOW)]
    prefix = np.full(n, -1, np.int64)
    if n > 1:
        for a in range(1, n, 1 << 16):
            b = min(n, a + (1 << 16))
            differ = strings[order[a:b]] != strings[order[a - 1 : b - 1]]
            prefix[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        prefix[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, prefix


def _words(rows: np.ndarray) -> np.ndarray:
    full = np.zeros((len(rows), 8), np.uint8)
    full[:, : rows.shape[1]] = rows
    return full.view(">u8").ravel().astype(np.uint64)


def blind_trie(strings: list[bytes], depth: int) -> np.ndarray:
    """Order of strings that agree in their first `depth` bytes, by a blind (compacted) trie.

    A node is [position, {byte: child}], a leaf a list of indices of equal strings. Going down looks at
    the branching bytes alone; one comparison with the leaf reached then tells where the string parts.
    """
    width = len(strings[0])

    def byte(s: bytes, at: int) -> int:
        return s[at] if at < width else -1

    root: list = [0]
    for index in range(1, len(strings)):
        new = strings[index]
        node = root
        while isinstance(node, tuple):
            children = node[1]
            node = children.get(byte(new, node[0])) or next(iter(children.values()))
        seen = strings[node[0]]
        if seen == new:
            node.append(index)
            continue
        a, b = int.from_bytes(seen[depth:], "big"), int.from_bytes(new[depth:], "big")
        parts = width - ((a ^ b).bit_length() + 7) // 8
        above, node = None, root
        while isinstance(node, tuple) and node[0] < parts:
            above, node = (node, byte(new, node[0])), node[1].get(byte(new, node[0]))
        if isinstance(node, tuple) and node[0] == parts:
            node[1][byte(new, parts)] = [index]
            continue
        fork = (parts, {byte(seen, parts): node, byte(new, parts): [index]})
        if above is None:
            root = fork
        else:
            above[0][1][above[1]] = fork
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return np.array(out)


def repeated_windows(h, doc, pos, back, fore, around) -> np.ndarray:
    """For each point (rows) and distance from its anchor (columns): is that window a repeat of an earlier one?

    Points must be ordered by document and position.
    """
    n = len(h)
    out = np.zeros((n, REACH + 1), bool)
    group = np.unique(h, return_inverse=True)[1]
    right_order, right = deep_shallow(around[:, REACH:], group)
    left_order, left = deep_shallow(np.ascontiguousarray(around[:, REACH - 1 :: -1] if REACH else around[:, :0]), group)
    for distance in range(REACH + 1):
        own = np.flatnonzero((fore <= distance) & (distance <= back))
        if len(own) < 2:
            continue
        r, l = np.empty(n, np.int64), np.empty(n, np.int64)  # noqa: E741
        r[right_order] = np.cumsum(right < LENGTH - distance)
        l[left_order] = np.cumsum(left < distance)
        key = (l[own] << 32) | r[own]
        order = np.argsort(key, kind="stable")  # the earliest point of each class comes first
        same = np.zeros(len(own), bool)
        same[1:] = key[order][1:] == key[order][:-1]
        out[own[order[same]], distance] = True
    return out


def _fourth_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a bucket to spans of repeated windows."""
    for _, rows in _by_block(batches):
        h, doc, pos, back, fore, around = (np.concatenate(c) for c in zip(*(_unpack(r[2], *RECORD_TYPES) for r in rows)))
        pos = pos.astype(np.int64)
        order = np.lexsort((pos, doc))
        h, doc, pos, back, fore, around = (c[order] for c in (h, doc, pos, back, fore, around))
        text = around.view(np.uint8).reshape(len(h), AROUND)
        again = repeated_windows(h, doc, pos, back, fore, text)
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, nearest = np.nonzero(edge == 1)
        _, beyond = np.nonzero(edge == -1)
        if len(row):
            yield _span_rows(doc[row], pos[row] - (beyond - 1), pos[row] - nearest + LENGTH)


def _compressed(docs: DataFrame) -> DataFrame:
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data = [small(t.as_py()) for t in column(batch, "text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(keys // BLOCK), pa.array(np.full(len(keys), TEXTS, np.int32)), pa.array(keys), pa.array(data, pa.binary())], ["block", "kind", "key", "data"])

    return docs.select(KEY, "text").mapInArrow(squeeze, PACKED)


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("block").sortWithinPartitions("block", "kind")


KEY = "_lumenspan_key"


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with KEY, a distinct long that gives the order of documents, and whether that is doc_id itself."""
    docs = docs.withColumn(KEY, F.col("doc_id").cast("long"))
    if docs.where(F.col(KEY).isNull()).isEmpty() and docs.groupBy(KEY).count().where("count > 1").isEmpty():
        return docs, True
    ordered = docs.drop(KEY).orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return stored(ordered.withColumn(KEY, F.monotonically_increasing_id()), "keyed"), False  # ascending in sorted partitions


def _buckets(docs: DataFrame) -> int:
    """About one for each MB that the optimizer expects to read."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(1 << 20, max(64, size >> 20))


def repeats(docs: DataFrame) -> DataFrame:
    """Packed spans (block, kind, key, data) of all bytes to remove; docs come from keyed()."""
    spark = docs.sparkSession
    ship(spark)
    buckets = _buckets(docs)
    first = docs.select(KEY, "text").mapInArrow(_first_pass(buckets), PACKED)
    # spans pass through the exchange beside the anchors, so the texts are hashed once
    second = _dealt(first).mapInArrow(_with_spans(_second_pass(HOT_ANCHORS, HELD_ANCHORS)), PACKED)
    second = stored(second, "second")
    release(spark)
    points = second.where(F.col("kind") == ANCHORS)
    third = _dealt(points.union(_compressed(docs))).mapInArrow(_third_pass(buckets, CHUNK), PACKED)
    # stored, so that the texts and surroundings sent up to here are deleted before the texts are sent to their spans
    fourth = stored(_dealt(third).mapInArrow(_with_spans(_fourth_pass), PACKED), "fourth")
    release(spark)
    return second.where(F.col("kind") == SPANS).union(fourth)


def _with_spans(step):
    """step over the anchors of its batches; their spans pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def anchors_only() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.column(1).to_numpy()
                spans.append(batch.filter(pa.array(kind == SPANS)))
                yield batch.filter(pa.array(kind == ANCHORS))

        spans: list[pa.RecordBatch] = []
        for out in step(anchors_only()):
            yield from spans
            spans.clear()
            yield out
        yield from spans

    return run


def _finish(batches: Iterator[pa.RecordBatch], finish) -> Iterator[pa.RecordBatch]:
    """Calls finish(rows) for runs of (key, raw text, span starts, span ends)."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    held, size = [], 0
    for _, rows in _by_block(batches):
        spans: list[list[np.ndarray]] = []
        table = None
        for kind, key, raw in rows:
            if kind == SPANS:
                spans.append(_unpack(raw, *SPAN_TYPES))
                continue
            if table is None:
                table = merged(*(np.concatenate(c).astype(np.int64) for c in zip(*spans))) if spans else (np.zeros(0, np.int64),) * 3
            a, b = np.searchsorted(table[0], [key, key + 1])
            held.append((key, expand(raw), table[1][a:b].tolist(), table[2][a:b].tolist()))
            size += len(held[-1][1])
            if size > 8 << 20:
                yield finish(held)
                held, size = [], 0
    if held:
        yield finish(held)


def kept(raw: bytes, begins: list[int], ends: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*begins, len(raw)]))


def _finished(docs: DataFrame, finish, schema: str) -> DataFrame:
    """finish() over the texts of docs (from keyed()) beside their spans."""
    return _dealt(repeats(docs).union(_compressed(docs))).mapInArrow(lambda batches: _finish(batches, finish), schema)


def _with_ids(out: DataFrame, docs: DataFrame, same: bool) -> DataFrame:
    """KEY back to doc_id."""
    if same:
        return out.withColumnRenamed(KEY, "doc_id")
    return docs.select(KEY, "doc_id").join(out, KEY).drop(KEY)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs, same = keyed(docs.select("doc_id", "text"))

    def finish(rows) -> pa.RecordBatch:
        left = [kept(raw, begins, ends) for _, raw, begins, ends in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(x, pa.int64()) for x in ([len(r[1]) for r in rows], [len(r[1]) - len(x) for r, x in zip(rows, left)], [len(r[2]) for r in rows])), pa.array([hashlib.sha256(x).hexdigest() for x in left])],
            [KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return _with_ids(_finished(docs, finish, f"{KEY} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), docs, same)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, begin, end (bytes) of every maximal removed run."""
    docs, same = keyed(docs.select("doc_id", "text"))

    def finish(rows) -> pa.RecordBatch:
        flat = [(r[0], a, b) for r in rows for a, b in zip(r[2], r[3])]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in range(3)], [KEY, "begin", "end"])

    return _with_ids(_finished(docs, finish, f"{KEY} long, begin long, end long"), docs, same)


def whole_characters(raw: bytes, begins: list[int], ends: list[int]) -> bytes:
    """What is left if only characters all of whose bytes are removed go."""
    def forward(at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    def backward(at: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    pairs = [(a, b) for a, b in ((forward(a), backward(b)) for a, b in zip(begins, ends)) if a < b]
    return kept(raw, [a for a, _ in pairs], [b for _, b in pairs])


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated characters taken out of text, and n_chars counted anew; all other columns stay."""
    columns = docs.columns
    docs, _ = keyed(docs)

    def finish(rows) -> pa.RecordBatch:
        left = [whole_characters(raw, begins, ends).decode() for _, raw, begins, ends in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(left)], [KEY, "text"])

    texts = _finished(docs, finish, f"{KEY} long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.drop("text", "n_chars").join(texts, KEY).select(*columns)
