"""The decision log as a stream: the evidence fold and claim states (E02 to E06), and windowed counts with late data bounded.

The fold's state is the greatest event of each kind by seq for a claim's piece of evidence, which no order of arrival changes:
a late event is folded whenever it comes, and a claim with very much evidence is spread over many keys. Each micro-batch writes
the keys that it changed to a folder of its own, overwritten if the batch is run again, so restarts repeat nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators.decisions import claim_events, evidence_states, states


def windowed_decisions(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events(ts, claim_id, event_type) to (begin, claim_id, n_events, n_support); the batch form is the same call on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "claim_id").agg(F.count("*").alias("n_events"), F.count(F.when(F.col("event_type") == "add_support", 1)).alias("n_support"))
    return out.select(F.col("w.start").alias("begin"), "claim_id", "n_events", "n_support")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available of an appendable stream to Parquet, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def follow(events: DataFrame, path: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Fold all that is available of a stream of events; the changed keys of each micro-batch go below path."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    stream = fold(events).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
    stream.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key that follow() wrote."""
    rows = spark.read.parquet(f"{path}/changes")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def streamed_states(events: DataFrame, claims: DataFrame, path: str) -> DataFrame:
    """states() of a stream of events, from the state that its fold has reached."""
    spark = events.sparkSession
    follow(events, f"{path}/evidence", evidence_states)
    follow(events, f"{path}/claims", claim_events)
    return states(latest(spark, f"{path}/evidence", ["claim_id", "evidence_id"]), latest(spark, f"{path}/claims", ["claim_id"]), claims)
