"""Jump consistent hashing: stable keys to shards without a ring table, in DataFrame expressions alone.

A key's jumps depend on the key only, so a shard count of n + 1 moves just the keys whose last jump
lands on shard n. The 64-bit congruential generator is written in 32-bit halves, since long arithmetic
that overflows is an error under ANSI mode.

Defined cases: a null key hashes as the number 0, a key that isn't a whole number by its XXH64; null text has
no bytes; equal rows get slots of their own; an empty table gives no rows; extra columns stay out of the
result; texts of any length are only measured and summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenspan.session import stored

#: The multiplier of the generator that the method's paper gives, as its upper and lower half.
MULTIPLIER = 2862933555777941757
HIGH, LOW, MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF
#: Rows that are numbered together in all shards, as long as there are no more than BLOCKS such blocks.
SLOT_ROWS, BLOCKS = 1 << 16, 1 << 14


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """One step of the generator on the halves of its state: state * MULTIPLIER + 1 modulo 2**64."""
    l0, l1 = low.bitwiseAND(0xFFFF), F.shiftright(low, 16)
    t0, t1 = l0 * LOW, l1 * LOW
    total = t0 + F.shiftleft(t1.bitwiseAND(0xFFFF), 16) + 1
    h0, h1 = high.bitwiseAND(0xFFFF), F.shiftright(high, 16)
    crossed = (h0 * LOW).bitwiseAND(MASK) + F.shiftleft((h1 * LOW).bitwiseAND(0xFFFF), 16) + (low * HIGH).bitwiseAND(MASK)
    return (F.shiftright(total, 32) + F.shiftright(t1, 16) + crossed).bitwiseAND(MASK), total.bitwiseAND(MASK)


def jumps(key: Column, shards: int) -> tuple[Column, Column]:
    """A long key's shard among `shards`, and among one more."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    begin = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(MASK).alias("low"),
        long(0).alias("now"), long(0).alias("grown"), long(0).alias("jump"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        on = state["jump"] <= shards
        # (bucket + 1) * 2**31 / ((state >> 33) + 1)
        jump = F.floor((state["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.struct(
            high.alias("high"), low.alias("low"),
            F.when(state["jump"] < shards, state["jump"]).otherwise(state["now"]).alias("now"),
            F.when(on, state["jump"]).otherwise(state["grown"]).alias("grown"),
            F.when(on, jump).otherwise(state["jump"]).cast("long").alias("jump"),
        )

    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), begin, step)
    return last["now"].cast("int"), last["grown"].cast("int")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """Rows with key, size, text_crc32, shard, grown_shard (one shard more) and slot, gapless from 0 in each shard.

    Rows are numbered once, and dealt by a hash of that number to blocks, whatever their keys are; slots count
    inside (shard, block), and the rows of earlier blocks are added from a table of at most BLOCKS counts a shard.
    """
    whole = isinstance(docs.schema[key].dataType, IntegralType)
    number = F.col("_key").cast("long") if whole else F.when(F.col("_key").isNotNull(), F.xxhash64("_key"))
    rows = docs.select(
        F.col(key).alias("_key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = rows.withColumn("_both", F.struct(*jumps(number, shards))).select("_key", "size", "text_crc32", "_row", F.col("_both.col1").alias("shard"), F.col("_both.col2").alias("grown_shard"))
    rows = stored(rows, "sharded")
    blocks = max(1, min(BLOCKS, -(-rows.count() // SLOT_ROWS)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    before = (
        rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_row")))
    return numbered.join(F.broadcast(before), ["shard", "_block"]).select(  # BLOCKS * shards rows at most
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_place") - 1).alias("slot"), "grown_shard"
    )
