"""Quality rules: base rules on counts, then robust multivariate outliers in each language and source.

Four statistics of every text that passes the base rules (mean word length, symbols a word, share of repeated lines,
share of words in repeated windows) are transformed to a vector. For each cell, a language and source with MIN_CELL such
texts or more, the minimum covariance determinant is estimated over all its rows: concentration steps from two starts
(moments of all rows; medians and quartiles), each of which keeps the `cover` of rows nearest to the centre, until the
determinant no longer falls; the start with the smaller determinant counts, and one reweighted step follows. Rows whose
squared Mahalanobis distance passes the chi-square bound of `tail` are rejected.

A step is one aggregation of moments by bins of the distance, combined before the shuffle, so a cell with a third
of all rows is as cheap as another: the rows nearest to the centre are those of the first bins, ties included. Rows of
smaller cells form a cell of their language, and what is left then one cell, REST; fewer than MIN_CELL there are not
judged. Statistics that are equal in most texts have no spread, so FLOORS is added to every cell's spread: a difference
below a few floors never rejects a text.

Defined cases: null text has no words and fails the base rules; null languages and sources are cells like others; repeated
rows all stay and count each; an empty table gives no rows; extra columns stay out of the result. A slice of about
SLICE_BYTES, or one longer text, is in a worker's memory with its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.tokens import column, slices
from lumenspan.session import discard, ship, stored

#: White space between words, and signs that count as symbols.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Spread added to log word length, root of symbols a word, and the two shares.
FLOORS = (0.05, 0.08, 0.15, 0.15)
P = len(FLOORS)
MIN_CELL, MIN_WORDS = 200, 50
#: Bins of a doubling of the squared distance; steps at most; parts of a floor that medians are told to.
BINS, STEPS, GRID = 32, 30, 8
#: Cells whose estimates are broadcast (some 300 bytes each); beyond that rows are joined to them, dealt by SALTS.
BROADCAST_CELLS, SALTS = 20_000, 64

#: The cell of rows whose language is too small; no JSON object, since that of a null language is {}.
REST = "rest"

X = [f"x{i}" for i in range(P)]
UPPER = [(i, j) for i in range(P) for j in range(i, P)]
MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}{j}" for i, j in UPPER)]
ESTIMATE = [*(f"m{i}" for i in range(P)), *(f"p{i}{j}" for i, j in UPPER), "logdet"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = ids[:-2] * len(numbers) + ids[1:-1]
    if len(numbers) >= 1 << 21:  # three numbers would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, back, counts = np.unique(pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def counts_of(raw: bytes) -> tuple[int, ...]:
    """The five counts of BASE, and the number of lines with a word."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(raw.translate(None, SPACE).decode())
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, group (language and source as JSON), lang_group, the counts of BASE, n_lines and base_failed."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    group, language = (F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in names))) for names in (("lang", "source"), ("lang",)))
    rows = docs.select(F.col(key).alias("_key"), group.alias("group"), language.alias("lang_group"), F.col("text").cast("string").alias("text"))
    names = [*BASE, "n_lines"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for a, b in slices(texts):
                found = np.array([counts_of(t) for t in texts.slice(a, b - a).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(names))
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([some.column(0), *(some.column(k).cast(pa.string()) for k in (1, 2)), *(pa.array(found[:, k]) for k in range(len(names)))], ["_key", "group", "lang_group", *names])

    out = rows.mapInArrow(count, f"_key {kind}, group string, lang_group string, " + ", ".join(f"{n} long" for n in names))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics of a row that passed the base rules."""
    n = F.col("n_words").cast("double")
    return [F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / n]


def _cells(stats: DataFrame) -> DataFrame:
    """(group, cell): where the rows of each language and source are judged; null: nowhere."""
    groups = stats.where(~F.col("base_failed")).groupBy("group", "lang_group").agg(F.count("*").alias("n"))
    large = F.col("n") >= MIN_CELL
    small = groups.where(~large)
    languages = small.groupBy("lang_group").agg(F.sum("n").alias("n_lang"))
    rest = languages.where(F.col("n_lang") < MIN_CELL).agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n"))
    whole = rest.first()["n"] >= MIN_CELL
    pooled = small.join(languages, "lang_group").select("group", F.when(F.col("n_lang") >= MIN_CELL, F.col("lang_group")).otherwise(F.lit(REST if whole else None).cast("string")).alias("cell"))
    return groups.where(large).select("group", F.col("group").alias("cell")).unionByName(pooled)


def _beside(rows: DataFrame, table: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has one row (or a few) for each key, n rows in all."""
    if n <= BROADCAST_CELLS:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def _sums() -> list[Column]:
    one = [F.count("*").cast("double").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X))]
    return one + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in UPPER]


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by the inverse p00.."""
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    total = F.lit(0.0)
    for i, j in UPPER:
        total = total + d[i] * d[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def bin_of(squared: Column) -> Column:
    return F.floor(BINS * F.log2(squared + 1e-3)).cast("int")


def upper_tail(x: float, p: int) -> float:
    """P(chi-square with an even number p of degrees of freedom > x)."""
    term = total = 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def quantile(tail: float, p: int = P) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_tail(mid, p) > tail else (low, mid)
    return high


def consistency(cover: float, p: int = P) -> float:
    """What makes the covariance of the nearest `cover` of normal rows that of all."""
    return cover / (1 - upper_tail(quantile(1 - cover, p), p + 2)) if cover < 1 else 1.0


def estimate(moments: np.ndarray, factor: float) -> list[float]:
    """Centre, inverse and log determinant from MOMENTS; FLOORS is added to the covariance."""
    n, mean = moments[0], moments[1 : P + 1] / moments[0]
    cov = np.zeros((P, P))
    for k, (i, j) in enumerate(UPPER):
        cov[i, j] = cov[j, i] = moments[P + 1 + k] / n - mean[i] * mean[j]
    return spread(mean, factor * cov)


def spread(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    cov = cov + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(cov)
    return [*mean.tolist(), *(float(inverse[i, j]) for i, j in UPPER), float(np.linalg.slogdet(cov)[1])]


def concentrated(some: pd.DataFrame, cover: float) -> list[float]:
    """The estimate from the first bins that hold the share `cover` of a cell's rows."""
    some = some.sort_values("bin")
    n = some["n"].to_numpy()
    upto = int(np.searchsorted(np.cumsum(n), math.ceil(cover * n.sum()) - 0.5)) + 1
    taken = some[MOMENTS].to_numpy()[:upto].sum(0)
    return estimate(taken, consistency(cover))


def _estimates(table: DataFrame, fit, keys: list[str]) -> DataFrame:
    """fit(rows of a cell) for each cell: bins or coordinates of one cell, never its documents."""
    columns = [*keys, *ESTIMATE]

    def one(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(some[k].iloc[0] for k in keys), *fit(some)]], columns=columns)

    kinds = {"cell": "string", "start": "int"}
    return table.groupBy(*keys).applyInPandas(one, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))


def robust_start(some: pd.DataFrame) -> list[float]:
    """Medians and quartiles of each statistic from counts of its grid cells."""
    mean, sd = [], []
    for i in range(P):
        part = some[some["i"] == i].sort_values("q")
        upto, q = part["n"].cumsum().to_numpy(), part["q"].to_numpy()
        low, mid, high = (float(q[np.searchsorted(upto, share * upto[-1])]) * FLOORS[i] / GRID for share in (0.25, 0.5, 0.75))
        mean.append(mid)
        sd.append((high - low) / 1.349)
    return spread(np.array(mean), np.diag(np.square(sd)))


def estimates(rows: DataFrame, n_cells: int, cover: float) -> DataFrame:
    """(cell, centre, inverse): reweighted minimum covariance determinants of rows(cell, x0..)."""
    first = _estimates(rows.groupBy("cell").agg(*_sums()), lambda s: estimate(s[MOMENTS].to_numpy()[0], 1.0), ["cell"]).withColumn("start", F.lit(0))
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.round(F.col(x) * (GRID / FLOORS[i])).cast("long").alias("q")) for i, x in enumerate(X))))
    placed = rows.select("cell", grid.alias("g")).groupBy("cell", "g.i", "g.q").agg(F.count("*").alias("n"))
    second = _estimates(placed, robust_start, ["cell"]).withColumn("start", F.lit(1))
    now = stored(first.unionByName(second), "estimates")
    before = math.inf
    for _ in range(STEPS):
        binned = _beside(rows, now, "cell", 2 * n_cells).groupBy("cell", "start", bin_of(distance()).alias("bin")).agg(*_sums())
        after = stored(_estimates(binned, lambda s: concentrated(s, cover), ["cell", "start"]), "estimates")
        discard(now)
        now, total = after, after.agg(F.sum("logdet").alias("d")).first()["d"]
        if total is None or total > before - 1e-9 * max(1.0, abs(total)):
            break
        before = total
    best = now.groupBy("cell").agg(F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "start")).alias("e")).select("cell", "e.*")
    inner = 0.025
    near = _beside(rows, best, "cell", n_cells).where(distance() <= quantile(inner)).groupBy("cell").agg(*_sums())
    out = stored(_estimates(near, lambda s: estimate(s[MOMENTS].to_numpy()[0], consistency(1 - inner)), ["cell"]), "estimates")
    discard(now)
    return out


def judged(docs: DataFrame, key: str = "doc_id", cover: float = 0.6, tail: float = 1e-6) -> DataFrame:
    """key, the counts of BASE, base_failed, kept, cell (JSON; null: not judged) and distance (Mahalanobis; null: not judged)."""
    stats = stored(statistics(docs, key), "statistics")
    cells = stored(_cells(stats), "cells")
    sizes = cells.agg(F.count("*").alias("groups"), F.countDistinct("cell").alias("cells")).first()
    passed = F.when(~F.col("base_failed"), F.col("cell"))
    rows = _beside(stats, cells, "group", sizes["groups"], "left").withColumn("cell", passed)
    rows = stored(rows.select("_key", *BASE, "base_failed", "cell", *(F.when(F.col("cell").isNotNull(), v).alias(x) for v, x in zip(vector(), X))), "vectors")
    discard(stats)
    found = estimates(rows.where("cell IS NOT NULL"), sizes["cells"], cover)
    squared = _beside(rows, found, "cell", sizes["cells"], "left").withColumn("_d", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d") <= quantile(tail), F.lit(True))
    return squared.select(F.col("_key").alias(key), *BASE, "base_failed", kept.alias("kept"), "cell", F.when(F.col("cell").isNotNull(), F.round(F.sqrt("_d"), 4)).alias("distance"))
