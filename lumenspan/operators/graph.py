"""Graph retrieval over accepted edges(src, dst, type, confidence) (G and A17, A23, A28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def neighbours(edges: DataFrame) -> DataFrame:
    """Each node's neighbours by (confidence, type) descending, then id, with their rank."""
    order = Window.partitionBy("src").orderBy(F.desc("confidence"), F.desc("type"), "dst")
    return both_ways(edges).withColumn("rank", F.row_number().over(order))


def _ordered(seeds: DataFrame) -> DataFrame:
    """seeds(node[, place]) once each, with a place: the given one, else the node."""
    place = F.col("place") if "place" in seeds.columns else F.col("node")
    return seeds.where("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("place"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 2, cap: int | None = None) -> DataFrame:
    """Nodes (node, depth) within `depth` steps of seeds(node[, place]); with a cap, the first that a queue would visit.

    A queue visits seeds by their place (of equal places the smaller node), then neighbours in the order of their parents,
    each by (confidence, type) descending, then id. That order is the order of the lists (seed, rank, rank, ...), so no
    node is ever numbered by one task: a step keeps its first `cap` nodes by a top-k, and of a node's neighbours
    only the first `cap` can be among them. The capped result has `place`, from 1. Null ids are left out, repeated edges
    count once, seeds without edges stay; no seeds give no rows.
    """
    both = both_ways(edges).where("src IS NOT NULL AND dst IS NOT NULL")
    if cap is None:
        seen = front = _ordered(seeds).select("node", F.lit(0).alias("depth"))
        steps = both.select("src", "dst").distinct()
        for step in range(1, depth + 1):
            found = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
            front = found.join(seen, "node", "left_anti").withColumn("depth", F.lit(step))
            seen = seen.unionByName(front)
        return seen
    first = _ordered(seeds).orderBy("place", "node").limit(cap)
    first = first.withColumn("way", F.array(F.row_number().over(Window.orderBy("place", "node"))))  # cap rows
    seen = front = first.select("node", F.lit(0).alias("depth"), "way")
    best = F.max(F.struct("confidence", "type")).alias("best")
    for step in range(1, depth + 1):
        near = both.join(F.broadcast(front.select(F.col("node").alias("src"), "way")), "src").groupBy("src", "way", "dst").agg(best)
        order = Window.partitionBy("src").orderBy(F.desc("best.confidence"), F.desc("best.type"), "dst")
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
        found = near.groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("way", F.array("rank"))).alias("way"))
        found = found.join(F.broadcast(seen.select("node")), "node", "left_anti")  # cap rows for each step
        front = found.orderBy("way").limit(cap).select("node", F.lit(step).alias("depth"), "way")
        seen = seen.unionByName(front)
    seen = seen.orderBy("depth", "way").limit(cap)
    return seen.select("node", "depth", F.row_number().over(Window.orderBy("depth", "way")).alias("place"))  # cap rows


def terms(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text.cast("string")), F.lit("[a-z0-9]+"), F.lit(0)))


def simple_paths(edges: DataFrame, seeds: DataFrame, longest: int = 3, limit: int = 6, query: tuple[str, ...] = ()) -> DataFrame:
    """Simple paths from seeds(node) of up to `longest` edges, the first `limit` by (length, score) descending, then path.

    score = sum of confidence + .15 length + .2 for each word of the query that a node's name holds.
    """
    steps = both_ways(edges).select("src", "dst", "confidence")
    now = seeds.select(F.array("node").alias("path"), F.lit(0.0).alias("total"))
    out = None
    for _ in range(longest):
        now = now.join(steps, F.element_at("path", -1) == steps["src"]).where(~F.array_contains("path", F.col("dst")))
        now = now.groupBy(F.concat("path", F.array("dst")).alias("path")).agg(F.max(F.col("total") + F.col("confidence")).alias("total"))
        out = now if out is None else out.unionByName(now)
    n = F.size("path") - 1
    shared = F.size(F.array_intersect(terms(F.array_join("path", " ")), F.array(*map(F.lit, query)))) if query else F.lit(0)
    out = out.select("path", n.cast("long").alias("n_edges"), F.round(F.col("total") + 0.15 * n + 0.2 * shared, 6).alias("score"))
    return out.orderBy(F.desc("n_edges"), F.desc("score"), "path").limit(limit)


def primers(edges: DataFrame, seeds: DataFrame, members: DataFrame, communities: int = 2, each: int = 3, most: int = 6) -> DataFrame:
    """(node, place) to search from: seeds(node[, place]), then the nodes with most edges of the nearest communities.

    members(node, community). The nearest communities hold most seeds, then the largest share of seeds (rounded to
    three digits), then have the smaller id; of each the first `each` nodes by degree, then id, are taken, and the first
    `most` of all are kept, each once. Only top-k's are ordered, so a community of any size is never in one task.
    """
    seeds = _ordered(seeds).orderBy("place", "node").limit(most)
    held = members.where("node IS NOT NULL AND community IS NOT NULL").select("node", "community").distinct()
    marked = held.join(F.broadcast(seeds.select("node", F.lit(1).alias("_seed"))), "node", "left")
    sizes = marked.groupBy("community").agg(F.count("_seed").alias("n"), F.count("*").alias("size")).where("n > 0")
    nearest = sizes.orderBy(F.desc("n"), F.desc(F.round(F.col("n") / F.col("size"), 3)), "community").limit(communities)
    nearest = nearest.withColumn("_c", F.row_number().over(Window.orderBy(F.desc("n"), F.desc(F.round(F.col("n") / F.col("size"), 3)), "community")))
    inside = held.join(F.broadcast(nearest.select("community", "_c")), "community")
    ranked = inside.join(degrees(edges), "node", "left").withColumn("_m", F.row_number().over(Window.partitionBy("_c").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "node"))).where(F.col("_m") <= each)
    first = seeds.select("node", F.array(F.lit(0), F.row_number().over(Window.orderBy("place", "node"))).alias("way"))
    every = first.unionByName(ranked.select("node", F.array("_c", "_m").alias("way"))).groupBy("node").agg(F.min("way").alias("way"))
    return every.orderBy("way").limit(most).select("node", F.row_number().over(Window.orderBy("way")).alias("place"))


def hybrid(edges: DataFrame, seeds: DataFrame, members: DataFrame, query: tuple[str, ...] = ()) -> DataFrame:
    """The six best simple paths of at most two edges from the primers."""
    return simple_paths(edges, primers(edges, seeds, members), longest=2, limit=6, query=query)


def selected(paths: DataFrame, most: int = 18) -> DataFrame:
    """Nodes (node, place) of simple_paths() in the order in which its paths name them, the first `most`."""
    order = Window.orderBy(F.desc("n_edges"), F.desc("score"), "path")
    rows = paths.withColumn("_p", F.row_number().over(order)).select("_p", F.posexplode("path").alias("_k", "node"))  # a few paths
    found = rows.groupBy("node").agg(F.min(F.struct("_p", "_k")).alias("way")).orderBy("way").limit(most)
    return found.select("node", F.row_number().over(Window.orderBy("way")).alias("place"))


def degrees(edges: DataFrame) -> DataFrame:
    """Node and the number of its edge ends."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def controversies(claims: DataFrame) -> DataFrame:
    """Unordered pairs of accepted claims(source, target, relation) with several relations."""
    pairs = claims.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation")
    out = pairs.groupBy("a", "b").agg(F.countDistinct("relation").alias("n_relations"), F.array_join(F.array_sort(F.collect_set("relation")), "|").alias("relations"))
    return out.where("n_relations > 1")


def recommend(links: DataFrame, mentions: DataFrame, papers: DataFrame, query: list[str], limit: int = 5) -> DataFrame:
    """Papers by 2 * confidence for each (edge, evidence) + .35 for each mention + .4 for each query token + .01 max(0, year - 2020).

    links(paper_id, confidence), mentions(paper_id), papers(paper_id, text, year). Papers with neither link
    nor mention aren't recommended.
    """
    parts = links.select("paper_id", (2 * F.col("confidence")).alias("w")).unionByName(mentions.select("paper_id", F.lit(0.35).alias("w")))
    base = parts.groupBy("paper_id").agg(F.sum("w").alias("w"))
    shared = F.size(F.array_intersect(F.split(F.lower("text"), "[^a-z]+"), F.array(*map(F.lit, query))))
    score = F.col("w") + 0.4 * shared + 0.01 * F.greatest(F.lit(0), F.col("year") - 2020)
    return papers.join(base, "paper_id").select("paper_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "paper_id").limit(limit)
