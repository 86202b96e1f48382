"""Compression-distance classification: held-out accuracy and odd rows."""

import zlib

from lumenspan.llm import toxicity
from lumenspan.session import load


def auc(scores, marks):
    good = [s for s, m in zip(scores, marks) if m]
    bad = [s for s, m in zip(scores, marks) if not m]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    # 350 toxic texts in four languages are few to train a dictionary on: the README has the figures for 1,700
    assert auc([r["score"] for r in test], [marks[r["doc_id"]] for r in test]) > 0.75
    right = sum(r["predicted"] == marks[r["doc_id"]] for r in test)
    assert right > 0.93 * len(test)
    false_alarms = sum(r["predicted"] for r in test if not marks[r["doc_id"]])
    assert false_alarms < 0.02 * len(test)


def test_labels_of_the_held_out_fold_are_never_used(spark, sf):
    docs = load(spark, sf, "documents")
    labels = load(spark, sf, "labels")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]).cast("int"))
    assert toxicity.fit(docs, labels).__reduce__() == toxicity.fit(docs, turned).__reduce__()


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 0, int(i % 2)) for i in range(1, 16)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("toxic = 0"), labels.limit(0)):
        got = {r["doc_id"]: r["score"] for r in toxicity.classify(odd_docs, some).collect()}
        assert len(got) == odd_docs.count() and all(0 <= s <= 1 for s in got.values())
        assert got[3] == got[4] and got[0] == got[1] == got[2]
        assert toxicity.classify(no_docs, some).count() == 0
    kept = toxicity.without_toxic(odd_docs.withColumn("toxic_score", toxicity.F.lit("mine")), labels)
    assert kept.columns == [*odd_docs.columns, "toxic_score"] and {r["toxic_score"] for r in kept.collect()} <= {"mine"}


def test_windows_and_scores_against_plain_python():
    """Windows hold all words in order; a score is the curve over lengths under two fresh compressors."""
    import math

    import zstandard as z

    plain = [f"the calm river {k} runs by the old mill and the green hills of the valley " * 3 for k in range(60)]
    toxic = [t[:60] + " you vile wretch and rotten " + t[60:] for t in plain]
    model = toxicity.fit_texts(plain, toxic)
    how = z.ZstdCompressionParameters(compression_level=5, min_match=5, strategy=z.STRATEGY_LAZY, write_content_size=False)
    sizes = [lambda w, d=d: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w)) for d in (model.ordinary, model.toxic + model.ordinary)]
    for text in [plain[3] * 4, toxic[5], "", "!!! 123", "x" * 5000, "vile " * 300, "Ünï İ vile wretch"]:
        words = toxicity.words_of(text)
        cut, now = [], b" "
        for k, w in enumerate(words):
            now += w + b" "
            rest = sum(len(x) + 1 for x in words[k + 1 :])
            if len(now) > toxicity.WINDOW and rest >= toxicity.WINDOW // 4:
                cut.append(now)
                now = b" "
        cut += [now] if words else []
        assert list(toxicity.windows(toxicity.spaced(text), toxicity.WINDOW)) == cut
        assert b" ".join(c.strip() for c in cut) == b" ".join(words)
        gains = [sizes[0](w) - sizes[1](w) for w in (c if len(c) >= 64 else model.ordinary[-64:] + c for c in cut)]
        up = [g for g in gains if g > 0]
        strong, n = sum(g >= toxicity.STRONG for g in up), len(gains) + 1
        total = sum(len(w) + 1 for w in words) + 1
        want = [math.log1p(100 * sum(up) / (total + toxicity.WINDOW)), math.log1p(10 * len(up) / n), math.log1p(max(up, default=0)), math.log1p(len(up)), math.log1p(strong), math.log1p(10 * strong / n)]
        assert model.features(text) == want
        x = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], want))
        assert model.score(want) == 1 / (1 + math.exp(-max(-30, min(30, x))))


def test_sample_takes_one_row_of_an_id(spark):
    rows = [(k, f"calm text {k} about rivers and hills", 0) for k in range(30)] + [(100, f"vile wretch {k}", 1) for k in range(50)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert 0 <= toxicity.fit(docs, labels).score([0.0] * 6) <= 1


def test_long_texts_are_read_to_their_end():
    plain = ["the calm river runs by the old mill and the green hills " * 3, "a quiet day with bread and tea in the small house " * 3] * 20
    toxic = [t[:60] + f"you vile wretch {k} vile wretch " + t[60:] for k, t in enumerate(plain)]
    model = toxicity.fit_texts(plain, toxic)
    calm = plain[0] * 200
    assert model.score(model.features(calm + " vile wretch " * 40)) > model.score(model.features(calm))
    assert model.score(model.features(toxic[3])) > 0.5 > model.score(model.features(plain[1]))
