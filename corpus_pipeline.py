"""A corpus made ready for training: toxic documents go, near copies and repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; all but the last return the columns of documents. run() writes every stage to the shared folder
and reads it back. SQL can express none of the stages (dictionaries of a compressor, seeded hashes, suffix
orders, a tokenizer's ids), so ORACLE_SQL is None; tests/llm/test_pipeline.py holds them against brute force.

Defined cases: see the operators; null texts count as empty, and an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import nearcopies, packing, suffixes, toxicity
from lumenspan.session import load, stored

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by the classifier fitted to this corpus's labels."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one row of each component of near copies (five-word shingles, Jaccard 0.8; texts without words are one component).

    Fingerprints within three bits are compared first; nearcopies says how the links that they miss are found.

    It is the one with the smallest id; null ids come last, and the smallest text comes first among equal ids.
    """
    rows, _ = suffixes.keyed(docs)
    heads = nearcopies.near_copies(rows, suffixes.KEY).where("key = component").select(F.col("key").alias(suffixes.KEY))
    return rows.join(heads, suffixes.KEY, "left_semi").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters covered by 100-byte strings that start earlier; n_chars counted anew."""
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts with their sequence and place."""
    return packing.best_fit(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeats", drop_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
