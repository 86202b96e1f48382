"""Connected components by alternating stars over a distributed edge table.

A large star points every larger neighbour of a node to the smallest node it can see; a small star does
so for the smaller neighbours. Both only join the edges with a minimum for each node, so a hub of any
degree stays a partial aggregate and a skew-splittable join. Edges are written to the shared folder
after each round; only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.session import discard, stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(src, dst))").alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Nodes are of any orderable type. Null ends and loops are ignored: isolated nodes do not appear.
    """
    now = edges.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()) if (src, dst) != ("src", "dst") else edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = stored(now.where("src <> dst").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m").alias("dst")))
        old, now = now, stored(small.distinct(), "edges")
        discard(old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select("dst").distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("dst", "dst"))
