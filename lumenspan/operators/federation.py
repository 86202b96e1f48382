"""Several sources searched as one (S14): union, one paper for each identifier, relevance, rank, and what each source gave.

Defined cases: a source that failed or is absent (None) counts as asked and unsuccessful; null titles, summaries and concepts
are empty; no successful source gives no papers; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators.library import federated

# Results depend on exactly these.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9.+#/-]{1,}|[一-鿿]{2,}"
NO_TOKEN = ("and", "the", "for", "with", "using", "design", "system")
# End of fixed values.

PAPER = "paper_id string, title string, summary string, concepts array<string>, doi string, url string, tier int, year int"


def tokens(query: str, stop: tuple[str, ...] = ()) -> list[str]:
    return [t for t in dict.fromkeys(x.lower() for x in re.findall(TOKEN, query)) if t not in stop]


def _hits(words: list[str], weigh) -> Column:
    return reduce(lambda a, b: a + b, [weigh(w) for w in words], F.lit(0))


def search(spark: SparkSession, sources: dict[str, DataFrame | None], queries: list[str], n: int = 8) -> tuple[DataFrame, DataFrame]:
    """(papers, report). papers are the first n (paper_id, source, tier, year, official, score) of all sources together.

    Of papers with one identifier the least tier, then the longest summary, then the smallest id stays. Papers of tier 1
    are relevant, others with two of the queries' tokens or more. Official ones come first, then by score (3 for a token in
    the title, 1 elsewhere, authority, length of the summary), year and id. report has a row (source, successful, n_found)
    for each source.
    """
    names = [c.split()[0] for c in PAPER.split(", ")]
    found = [rows.select(*names).withColumn("source", F.lit(name)) for name, rows in sources.items() if rows is not None]
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], PAPER + ", source string")
    text = " ".join(queries)
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    words = F.array_join(F.coalesce("concepts", F.array().cast("array<string>")), " ")
    rows = federated(every).withColumns({"_title": F.lower(title), "_low": F.lower(F.concat_ws(" ", title, summary, words)), "_n": F.length(summary)})
    overlap = _hits(tokens(text, NO_TOKEN), lambda w: F.col("_low").contains(w).cast("int"))
    weight = _hits(tokens(text), lambda w: F.when(F.col("_title").contains(w), 3).when(F.col("_low").contains(w), 1).otherwise(0))
    score = weight + F.greatest(F.lit(0), 4 - F.col("tier")) * 2 + F.least(F.lit(2.0), F.col("_n") / 500)
    rows = rows.where((F.col("tier") == 1) | (overlap >= 2)).select("paper_id", "source", "tier", "year", (F.col("tier") == 1).cast("int").alias("official"), F.round(score, 6).alias("score"))
    counts = every.groupBy("source").agg(F.count("*").alias("n_found"))
    asked = spark.createDataFrame([(name, rows is not None) for name, rows in sources.items()], "source string, successful boolean")
    report = asked.join(counts, "source", "left").na.fill(0, ["n_found"])
    return rows.orderBy(F.desc("official"), F.desc("score"), F.desc("year"), "paper_id").limit(n), report
