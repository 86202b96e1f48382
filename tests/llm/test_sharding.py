"""Jump consistent hashing against plain Python."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenspan.llm import sharding
from lumenspan.session import load


def jump(key, shards):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jumps_equal_plain_python(spark):
    keys = [0, 1, 2, 7, 10**12, 2**63 - 1, -1, -(2**63), *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 40):
        now, grown = sharding.jumps(F.col("k"), shards)
        for r in df.select("k", now.alias("now"), grown.alias("grown")).collect():
            assert (r["now"], r["grown"]) == (jump(r["k"], shards), jump(r["k"], shards + 1))


def check(docs, shards=16):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = sharding.shard(docs, shards).collect()
    slots = defaultdict(list)
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], shards), jump(r["doc_id"], shards + 1))
        assert r["grown_shard"] in (r["shard"], shards)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_documents(spark, sf):
    check(load(spark, sf, "documents"))


def test_odd_documents(odd_docs, no_docs, spark):
    check(odd_docs)
    assert sharding.shard(no_docs).count() == 0
    twice = odd_docs.union(odd_docs).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    got = sharding.shard(twice).collect()
    assert Counter(r["shard"] for r in got) == {s: len({r["slot"] for r in got if r["shard"] == s}) for s in {r["shard"] for r in got}}
    assert len(got) == twice.count()


def test_hashed_equal_and_text_keys(spark, monkeypatch):
    """Blocks of slots are even whatever the keys are: 64-bit hashes, one key for a third of the rows, no numbers."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 200)
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.xxhash64("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard(rows).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 6000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    named = sharding.shard(spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("doc_id"), F.lit("t").alias("text"))).groupBy("shard").count().collect()
    assert len(named) == 16 and sum(r["count"] for r in named) == 2000


def test_shards_are_near_even(spark):
    got = sharding.shard(spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) < 1.1 * min(counts)


def test_main_path_runs_no_python(spark, sf):
    plan = sharding.shard(load(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
