"""Base counts and robust outliers against plain Python and numpy."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspan.llm import outliers as O
from lumenspan.session import load


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def plain_cells(rows):
    """(lang, source) to the cell it is judged in."""
    sizes = Counter((lang, source) for lang, source in rows)
    name = lambda **k: json.dumps({x: v for x, v in k.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)
    out = {g: name(lang=g[0], source=g[1]) for g, n in sizes.items() if n >= O.MIN_CELL}
    langs = Counter()
    for (lang, source), n in sizes.items():
        if n < O.MIN_CELL:
            langs[lang] += n
    rest = sum(n for n in langs.values() if n < O.MIN_CELL)
    for g in sizes:
        if g not in out:
            out[g] = name(lang=g[0]) if langs[g[0]] >= O.MIN_CELL else O.REST if rest >= O.MIN_CELL else None
    return out


def plain_distances(x, cover):
    """Distances of the rows of one cell by numpy over all rows at once."""
    floor = np.diag(np.square(O.FLOORS))
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    starts = [(x.mean(0), np.cov(x.T, bias=True) + floor)]
    grid = np.round(x * (O.GRID / np.array(O.FLOORS)))  # no ties at halves in these rows
    at = lambda share: np.sort(grid, axis=0)[math.ceil(share * len(x)) - 1] * np.array(O.FLOORS) / O.GRID
    starts.append((at(0.5), np.diag(np.square((at(0.75) - at(0.25)) / 1.349)) + floor))
    found = []
    for mean, cov in starts:
        for _ in range(O.STEPS):
            bins = np.floor(O.BINS * np.log2(np.maximum(d2(mean, cov), 0) + 1e-3))
            last = np.sort(bins)[math.ceil(cover * len(x)) - 1]
            near = x[bins <= last]
            mean, cov = near.mean(0), O.consistency(cover) * np.cov(near.T, bias=True) + floor
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])
    near = x[d2(mean, cov) <= O.quantile(0.025)]
    return np.sqrt(np.maximum(d2(near.mean(0), O.consistency(0.975) * np.cov(near.T, bias=True) + floor), 0))


def check(docs, cover=0.6, tail=1e-6):
    rows = docs.select("doc_id", "lang", "source", "text").collect()
    counts = [plain_counts(r["text"]) for r in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    cells = plain_cells([(r["lang"], r["source"]) for r, f in zip(rows, failed) if not f])
    members = defaultdict(list)
    for k, (r, f) in enumerate(zip(rows, failed)):
        if not f and cells[r["lang"], r["source"]]:
            members[cells[r["lang"], r["source"]]].append(k)
    want = [(r["doc_id"], *c[:5], f, not f, None, None) for r, c, f in zip(rows, counts, failed)]
    for cell, some in members.items():
        x = np.array([(math.log(c[1] / c[0]), math.sqrt(c[2] / c[0]), c[3] / c[5], c[4] / c[0]) for c in (counts[k] for k in some)])
        for k, d in zip(some, plain_distances(x, cover)):
            want[k] = (*want[k][:7], bool(d * d <= O.quantile(tail)), cell, d)
    order = lambda r: tuple(str(v) for v in r[:9])
    got = sorted((tuple(r) for r in O.judged(docs, cover=cover, tail=tail).collect()), key=order)
    want = sorted(want, key=order)
    assert [g[:9] for g in got] == [w[:9] for w in want]
    for g, w in zip(got, want):
        assert (g[9] is None) == (w[9] is None) and (g[9] is None or abs(g[9] - w[9]) < 0.02 * max(1, w[9]))
    return got


def test_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(O, "MIN_CELL", 40)
    got = check(load(spark, sf, "documents"))
    assert any(not r[7] and not r[6] for r in got) and {r[8] for r in got} > {None}


def prose(rng, n, junk=False):
    words = [("#$%" if junk else "") + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.1 else "") for w in words)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s1", None, f"rare{k}"])
        rows.append((k, lang, source, prose(rng, rng.randrange(50, 300), junk=k % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")


def test_planted_junk_goes_and_clean_texts_stay(planted, monkeypatch):
    monkeypatch.setattr(O, "MIN_CELL", 60)
    got = check(planted)
    assert all(r[7] == (r[0] % 6 != 0 or r[8] is None) for r in got)
    assert len({r[8] for r in got} - {None}) > 4 and sum(r[8] is None for r in got) < 60


def test_salted_join_gives_the_same(planted, monkeypatch):
    monkeypatch.setattr(O, "MIN_CELL", 60)
    want = sorted(map(str, O.judged(planted).collect()))
    monkeypatch.setattr(O, "BROADCAST_CELLS", 0)
    assert sorted(map(str, O.judged(planted).collect())) == want


def test_odd_documents(spark, odd_docs, no_docs):
    extra = odd_docs.withColumns({"n_words": F.lit("x"), "cell": F.lit(1), "group": F.lit(2), "kept": F.lit(3)})
    check(extra)
    check(odd_docs.union(odd_docs).withColumns({"lang": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")}))
    assert O.judged(no_docs).count() == 0
    long = spark.createDataFrame([(1, "en", "s", "word and more " * 600_000), (2, "en", "s", prose(random.Random(1), 900_000))], "doc_id long, lang string, source string, text string")
    check(long)


def test_equal_rows_have_no_spread(spark, monkeypatch):
    monkeypatch.setattr(O, "MIN_CELL", 10)
    text = prose(random.Random(2), 80)
    docs = spark.createDataFrame([(k, "en", "s", text) for k in range(50)] + [(99, "en", "s", "|# " * 70 + text)], "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r["kept"] for r in O.judged(docs).collect()}
    assert got.pop(99) is False and all(got.values())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t|\x0b\x1cé日"))
def test_counts_equal_plain_python(text):
    assert O.counts_of(text.encode()) == plain_counts(text)


def test_chi_square():
    assert abs(O.quantile(0.05) - 9.4877) < 1e-3 and abs(O.quantile(0.025, 6) - 14.449) < 1e-2
    assert O.consistency(1) == 1 and 1.3 < O.consistency(0.75) < 2
