"""Toxicity by compression distance with two zstandard dictionaries.

Both dictionaries are trained by zstandard, on windows of toxic and of ordinary labelled texts apart. They are
trained anew in rounds: the toxic one on the windows of toxic texts that save more under a dictionary of other
toxic texts than nearly all ordinary windows do, the ordinary one also on the ordinary windows that a toxic one
explains by mistake, so what is common to both kinds of text ends up in the ordinary one. A text is cut into windows; what a window
saves under the toxic dictionary (with the ordinary one behind it, so ordinary content costs the same) is its
evidence. A logistic curve over the savings, fitted to labelled rows, calibrates the score; 0.5 is the threshold.

The classifier is fitted on at most SAMPLE labelled rows of each class (the smallest hashes of their ids)
whose texts have at most SAMPLE_CHARS characters, and on at most 2 * TRAIN_WINDOWS distinct windows of a kind in a round; weights
restore the classes' shares. All texts are scored whole, one in memory at a time.

Defined cases: null text is empty; texts without letters have the score of no evidence; equal texts have
equal scores; of rows with equal ids the sample takes one (the least text); without toxic or without ordinary
labelled rows every score is the share of toxic rows (0 without labels); an empty table gives no rows; extra
columns are ignored or kept, see each function.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column
from lumenspan.session import ship

SAMPLE = 4000
SAMPLE_CHARS = 20_000
#: Bytes of a window that is scored, and of one that dictionaries are trained on.
WINDOW, TRAIN_WINDOW = 80, 28
TRAIN_WINDOWS = 80_000
#: Bytes that the ordinary dictionary starts with, that a round adds to it, and that it has at most.
ORDINARY, MISTAKES, LARGEST = 32768, 8192, 49152
#: Bytes that a window must save to be strong evidence.
STRONG = 5
#: For each round the bytes of the toxic dictionary, and the share of ordinary windows that a window must exceed to be learnt.
ROUNDS = ((8192, 0.99), (8192, 0.995), (4096, 0.998), (3072, 0.999), (2048, 0.999), (1536, 0.999))
#: Parts that toxic texts are dealt into; mistakes of a round that a dictionary can be trained on.
PARTS, FEW = 4, 200
#: Segment lengths that training covers text with: for the first dictionaries, for mistakes, and for toxic windows.
COVER_ORDINARY, COVER_MISTAKES, COVER_TOXIC, COVER_STEP = 64, 24, 16, 6

_TO_SPACE = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII signs and digits are spaces."""
    return text.lower().encode().translate(_TO_SPACE).split()


def windows(raw: bytes, least: int) -> Iterator[bytes]:
    """Runs of whole words of `least` bytes or a little more (the last may be a quarter longer or shorter)."""
    at, size = 0, len(raw)
    while at < size - 1:
        to = raw.find(b" ", at + least)
        if to < 0 or size - to < least // 4:
            to = size - 1
        yield raw[at : to + 1]
        at = to


def spaced(text: str) -> bytes:
    """A text's words, a space around each."""
    return b"".join(b" " + w for w in words_of(text)) + b" "


class Model:
    """Two dictionaries and the weights of the logistic curve."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float]):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._sizes = None

    def __reduce__(self):
        return Model, (self.toxic, self.ordinary, self.weights)

    def _start(self) -> None:
        import zstandard as z

        how = z.ZstdCompressionParameters(compression_level=5, min_match=5, strategy=z.STRATEGY_LAZY, write_content_size=False)
        compressors = []
        for content in (self.ordinary, self.toxic + self.ordinary):  # what is ordinary stays at equal distances
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=how)
            compressors.append(z.ZstdCompressor(dict_data=dictionary, compression_params=how).compress)
        self._sizes = compressors
        self._pad = self.ordinary[-64:]

    def gain(self, window: bytes) -> int:
        """Bytes that a window saves under the toxic dictionary."""
        if self._sizes is None:
            self._start()
        plain, toxic = self._sizes
        if len(window) < 64:  # too short a block is stored as it is, so it gets ordinary text to lean on
            window = self._pad + window
        return len(plain(window)) - len(toxic(window))

    def features(self, text: str) -> list[float]:
        raw = spaced(text)
        gains = np.array([self.gain(w) for w in windows(raw, WINDOW)])
        size, n, gains = len(raw), len(gains) + 1, gains[gains > 0] if len(gains) else gains
        strong = int((gains >= STRONG).sum())
        return [math.log1p(100 * float(gains.sum()) / (size + WINDOW)), math.log1p(10 * len(gains) / n), math.log1p(float(gains.max(initial=0))), math.log1p(len(gains)), math.log1p(strong), math.log1p(10 * strong / n)]

    def score(self, features: list[float]) -> float:
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary; too few samples to train on stand for themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=COVER_STEP).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def _train_windows(texts: list[str]) -> list[bytes]:
    """The distinct windows of all texts, in order."""
    return sorted({w for t in texts for w in windows(spaced(t), TRAIN_WINDOW)})


def _some(found: list[bytes], most: int, turn: int) -> list[bytes]:
    """At most `most` of them, others in each turn."""
    if len(found) <= most:
        return found
    return [found[k] for k in np.random.default_rng(turn).choice(len(found), most, replace=False)]


def fit_texts(ordinary: list[str], toxic: list[str], shares: tuple[float, float] | None = None) -> Model:
    """Model from two lists of texts; shares: rows that each ordinary and each toxic text stands for."""
    import xxhash

    if not toxic or not ordinary:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        return Model(b"", b" " * WINDOW, [math.log((share + 1e-6) / (1 - share + 1e-6)), *[0.0] * 6])
    # each part of the toxic texts is judged by a dictionary of the others, so what one text alone says isn't learnt
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for t in toxic:
        parts[xxhash.xxh64_intdigest(t) % PARTS].append(t)
    own, other = [_train_windows(p) for p in parts], _train_windows(ordinary)
    plain = trained(_some(other, TRAIN_WINDOWS, 0), ORDINARY, COVER_ORDINARY).rjust(WINDOW)
    learnt = [_some(w, TRAIN_WINDOWS // PARTS, 0) for w in own]
    for turn, (size, share) in enumerate(ROUNDS, 1):
        bad = [trained([w for j, some in enumerate(learnt) if j != k for w in some], size, COVER_TOXIC) for k in range(PARTS)]
        calm, mistakes = _some(other, TRAIN_WINDOWS, turn), []
        for k in range(PARTS):
            model, some = Model(bad[k], plain, []), calm[k::PARTS]
            gains = np.array([model.gain(w) for w in some])
            bound = max(0.0, float(np.quantile(gains, share))) if len(gains) else 0.0
            learnt[k] = [w for w in _some(own[k], 2 * TRAIN_WINDOWS // PARTS, turn) if model.gain(w) > bound]
            mistakes += [w for w, g in zip(some, gains) if g > 0]
        if len(mistakes) >= FEW:
            plain = (trained(mistakes, MISTAKES, COVER_MISTAKES) + plain)[:LARGEST]
    model = Model(trained([w for some in learnt for w in some], ROUNDS[-1][0], COVER_TOXIC), plain, [])
    x = np.array([[1.0, *model.features(t)] for texts in (ordinary, toxic) for t in texts])
    y = np.repeat([0.0, 1.0], [len(ordinary), len(toxic)])
    weight = np.repeat(shares or (1.0, 1.0), [len(ordinary), len(toxic)])
    model.weights = _logistic(x, y, weight / weight.mean()).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic curve."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from the labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("mark"))
    counts = {r["mark"]: r["n"] for r in known.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    # the ids are drawn from the labels alone, so texts are read once and only the sample's move
    drawn = [known.where(F.col("mark") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= SAMPLE_CHARS).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")  # 2 * sample ids at most
    texts: list[list[str]] = [[], []]
    for r in rows.groupBy("doc_id", "mark").agg(F.min("text").alias("text")).toLocalIterator():  # as many rows at most
        texts[r["mark"]].append((r["doc_id"], r["text"]))
    texts = [[t for _, t in sorted(x)] for x in texts]
    shares = tuple(counts.get(v, 0) / max(1, len(texts[v])) for v in (0, 1))
    return fit_texts(texts[0], texts[1], shares)


#: The column that scores() adds.
SCORE = "_lumenspan_toxic_score"


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and SCORE, from the text alone."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = docs.withColumn(SCORE, F.lit(0.0)).schema
    place = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            texts = column(batch, batch.schema.names[place])
            values = [own.score(own.features(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], schema.names)

    return docs.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, labels)
    out = scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; all columns stay."""
    return scores(docs, fit(docs, labels)).where(F.col(SCORE) < 0.5).drop(SCORE)
