"""Chroma fingerprints and alignment against brute force."""

import numpy as np

from lumenspan.llm import chroma
from pyspark.sql import functions as F


def test_filters_equal_plain_sums():
    rng = np.random.default_rng(0)
    image = rng.random((60, 12))
    got = chroma.packed(image).view(np.uint32)
    assert len(got) == 60 - chroma.WIDTH + 1
    for t in (0, 7, len(got) - 1):
        value = 0
        for kind, low, rows, wide in chroma.filters():
            cell = image[t : t + wide, low : low + rows]
            up, late = np.arange(rows) >= rows // 2, np.arange(wide) >= wide // 2
            middle = (np.arange(wide) >= wide // 3) & (np.arange(wide) < wide - wide // 3)
            pick = [~up[None, :] & np.ones((wide, 1), bool), ~late[:, None] & np.ones((1, rows), bool), up[None, :] == late[:, None], middle[:, None] & np.ones((1, rows), bool)][kind]
            ratio = np.log((1e-3 + cell[pick].sum()) / (1e-3 + cell[~pick].sum()))
            value = value << 2 | (0, 1, 3, 2)[sum(ratio > s for s in chroma.STEPS)]
        assert value == got[t]


def test_alignment_of_copies_excerpts_and_strangers(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(0, 0.125, 64) for _ in range(6)]
    tunes = {100 + k: chroma.tune(v) for k, v in enumerate(base)}
    tunes[200] = chroma.tune(base[0])  # a copy of 100
    tunes[201] = chroma.tune(np.concatenate([rng.normal(0, 0.125, 16), base[0][:48]]))  # 100, sixteen notes late
    noisy, rate = chroma.samples_of(tunes[101])
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((32000 * np.clip(noisy * 0.7 + rng.normal(0, 0.002, len(noisy)), -1, 1)).astype("<i2").tobytes())
    tunes[202] = out.getvalue()
    rows = [*tunes.items(), (300, None), (301, b"junk"), (None, tunes[103])]
    media = spark.createDataFrame(rows, "media_id long, media binary").withColumns({"frames": F.lit("x"), "key": F.lit(1), "part": F.lit(2)})
    got = chroma.search(media, F.col("media_id").isin(100, 101, 200)).collect()
    members = [r for r in got if r["match_id"] is None]
    assert sorted(str(r["media_id"]) for r in members) == sorted(str(r[0]) for r in rows)
    classes = {r["media_id"]: r["class_id"] for r in members}
    assert classes[200] == 100 and classes[202] == 101 and classes[None] == 103 and classes[201] == 201
    assert {r["n_frames"] for r in members if r["media_id"] in (300, 301)} == {0}
    pairs = {(r["class_id"], r["match_class"]): r for r in got if r["match_id"] is not None}
    assert set(pairs) == {(100, 201)}
    late = 16 * 0.125 * rate / chroma.HOP
    assert abs(pairs[100, 201]["offset"] + late) <= 1 and pairs[100, 201]["bit_error"] < 0.1
    assert chroma.search(media.limit(0), F.lit(True)).count() == 0


def prints_of(sound, phases=True):
    return [chroma.packed(chroma.chroma(sound[k * chroma.HOP // chroma.PHASES :])) for k in range(chroma.PHASES if phases else 1)]


def searched(spark, monkeypatch, asked, others):
    """Rows of search() over prints: asked {id: arrays by phase}, others {id: array}."""
    rows = [(k, True, v[0].tolist(), [x.tolist() for x in v[1:]]) for k, v in asked.items()] + [(k, False, v.tolist(), []) for k, v in others.items()]
    table = spark.createDataFrame(rows, chroma.PRINT)
    monkeypatch.setattr(chroma, "fingerprints", lambda media, asked: media)
    return chroma.search(table, F.lit(True)).collect()


def aligned(views, other):
    """Brute force: does any offset of any view come within MAX_ERROR over MIN_FRAMES?"""
    b = other.view(np.uint32)
    for a in (v.view(np.uint32) for v in views):
        for offset in range(-len(b) + chroma.MIN_FRAMES, len(a) - chroma.MIN_FRAMES + 1):
            low, high = max(0, offset), min(len(a), len(b) + offset)
            if high - low >= chroma.MIN_FRAMES and np.bitwise_count(a[low:high] ^ b[low - offset : high - offset]).mean() / 32 <= chroma.MAX_ERROR:
                return True
    return False


def test_recall_of_excerpts_and_noise_against_bit_error_alone(spark, monkeypatch):
    """Excerpts of sixteen notes half a hop off the grid, and noisy copies, against brute force over all pairs and offsets."""
    rng = np.random.default_rng(1)
    asked, others = {}, {}
    for k in range(24):
        sound, rate = chroma.samples_of(chroma.tune(rng.normal(0, 0.125, 40)))
        others[k] = prints_of(sound, False)[0]
        begin = 3000 + chroma.HOP // 2 + 16 * (k % 3)
        asked[100 + k] = prints_of(0.7 * sound[begin : begin + 8000] + rng.normal(0, 0.002, 8000))
        asked[200 + k] = prints_of(sound[7:] + rng.normal(0, (0.1, 0.3, 0.45)[k % 3], len(sound) - 7))
    want = {(q, m) for q, a in asked.items() for m, b in others.items() if aligned(a, b)}
    assert {(q, q % 100) for q in asked} <= want | {(q, q % 100) for q in range(200, 224)} and len(want) >= 44
    got = searched(spark, monkeypatch, asked, others)
    class_of = {r["media_id"]: r["class_id"] for r in got if r["match_id"] is None}
    pairs = {(r["class_id"], r["match_class"]) for r in got if r["match_id"] is not None}
    found = {(q, m) for q, m in want if class_of[q] == class_of[m] or (class_of[q], class_of[m]) in pairs}
    assert len(found) >= 0.95 * len(want)
    for r in got:
        if r["match_id"] is not None:
            assert aligned(asked[r["media_id"]], others[r["match_id"]] if r["match_id"] in others else asked[r["match_id"]][0])


def test_group_of_near_copies_is_a_class(spark, monkeypatch):
    """Near copies are tied by their keys alone: their links number fewer than the keys, and the class meets an excerpt once."""
    rng = np.random.default_rng(4)
    sound, _ = chroma.samples_of(chroma.tune(rng.normal(0, 0.125, 40)))
    copies = {k: prints_of(sound + rng.normal(0, 0.1, len(sound)), False)[0] for k in range(1, 31)}
    alone = prints_of(chroma.samples_of(chroma.tune(rng.normal(0, 0.125, 40)))[0], False)[0]
    got = searched(spark, monkeypatch, {100: prints_of(sound[4000:16000]), 0: prints_of(sound)}, copies | {50: alone})
    class_of = {r["media_id"]: r["class_id"] for r in got if r["match_id"] is None}
    assert class_of == {k: 0 for k in range(31)} | {100: 100, 50: 50}
    assert sorted((r["class_id"], r["match_class"]) for r in got if r["match_id"] is not None) == [(0, 100), (100, 0)]


def test_wave_files_of_other_widths_and_rates():
    import io
    import wave

    vector = np.random.default_rng(2).normal(0, 0.125, 40)
    plain = prints_of(chroma.samples_of(chroma.tune(vector))[0], False)[0]
    for width, rate in ((3, 4000), (3, 8000), (2, 11025), (4, 16000)):
        sound, _ = chroma.samples_of(chroma.tune(vector, rate=rate))
        whole = np.repeat((sound * (2 ** (8 * width - 1) - 1)).astype(np.int64), 2)  # two channels
        raw = whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2), w.setsampwidth(width), w.setframerate(rate)
            w.writeframes(raw)
        samples, found = chroma.samples_of(out.getvalue())
        assert found == rate and np.allclose(samples, sound, atol=1e-4)
        assert aligned([chroma.packed(chroma.chroma(samples, found))], plain)


def test_query_has_a_row_for_each_vector(spark, sf):
    from lumenspan.llm import queries
    from lumenspan.session import load

    got = queries.op9_chroma(spark, sf).collect()
    members = [r["media_id"] for r in got if r["match_id"] is None]
    assert sorted(members) == sorted(r["vec_id"] for r in load(spark, sf, "embeddings").collect())
    assert all(r["media_id"] % 100 == 0 for r in got if r["match_id"] is not None)
