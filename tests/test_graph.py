"""Graph searches against a queue and plain recursion."""

import random
from collections import defaultdict, deque

import pytest

from lumenspan.operators import graph as G

SCHEMA = "src string, dst string, type string, confidence double"


def neighbours(edges):
    out = defaultdict(list)
    for a, b, kind, c in edges:
        if a is not None and b is not None:
            out[a].append((b, c, kind))
            out[b].append((a, c, kind))
    for some in out.values():
        some.sort(key=lambda n: n[0])
        some.sort(key=lambda n: (n[1], n[2]), reverse=True)
    return out


def queue(edges, seeds, depth, cap):
    near, visited, waiting = neighbours(edges), {}, deque((s, 0) for s in seeds)
    while waiting and len(visited) < cap:
        node, d = waiting.popleft()
        if node in visited:
            continue
        visited[node] = d
        if d < depth:
            waiting.extend((n, d + 1) for n, _, _ in near.get(node, ()))
    return [(node, d, k) for k, (node, d) in enumerate(visited.items(), 1)]


def random_graph(rng, nodes, n):
    name = lambda: f"n{rng.randrange(nodes):02d}"
    return [(name(), name(), rng.choice(["USES", "REPORTS", "EXTENDS"]), rng.choice([0.5, 0.7, 0.9])) for _ in range(n)]


@pytest.mark.parametrize("nodes,n", [(8, 20), (40, 60), (60, 200)])
def test_capped_search_visits_what_a_queue_visits(spark, nodes, n):
    rng = random.Random(n)
    edges = random_graph(rng, nodes, n) + [(None, "n01", "USES", 0.5), ("n02", None, "USES", 0.5)]
    df = spark.createDataFrame(edges, SCHEMA)
    for cap in (1, 3, 18, 1000):
        for depth in (0, 1, 2, 3):
            seeds = [f"n{rng.randrange(nodes):02d}" for _ in range(3)] + ["absent"]
            given = spark.createDataFrame(list(enumerate(seeds, 1)), "place int, node string")
            got = G.reach(df, given, depth, cap).orderBy("place").collect()
            assert [tuple(r) for r in got] == queue(edges, seeds, depth, cap)
    every = {(r["node"], r["depth"]) for r in G.reach(df, given, 3).collect()}
    assert every == {(node, d) for node, d, _ in queue(edges, seeds, 3, 10**9)}


def test_a_hub_gives_its_best_neighbours(spark):
    edges = [("hub", f"leaf{k:04d}", "USES", (k * 7919 % 1000) / 1000) for k in range(1000)] + [(f"leaf{k:04d}", f"far{k}", "USES", 0.5) for k in range(0, 1000, 3)]
    got = G.reach(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame([("hub",)], "node string"), 2, 18).orderBy("place").collect()
    assert [tuple(r) for r in got] == queue(edges, ["hub"], 2, 18)


def test_empty_graphs(spark):
    none, seeds = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",), (None,)], "node string")
    assert [tuple(r) for r in G.reach(none, seeds, 2, 5).collect()] == [("a", 0, 1)]
    assert G.reach(none, seeds.limit(0), 2, 5).count() == 0 and G.reach(none, seeds.limit(0), 2).count() == 0
    members = spark.createDataFrame([], "node string, community string")
    assert [tuple(r) for r in G.primers(none, seeds, members).collect()] == [("a", 1)]
    assert G.hybrid(none, seeds, members).count() == 0


def plain_primers(edges, seeds, groups):
    near, out = neighbours(edges), list(dict.fromkeys(seeds))
    hits = [(len(set(seeds) & set(m)), round(len(set(seeds) & set(m)) / len(m), 3), c) for c, m in sorted(groups.items())]
    best = sorted((h for h in hits if h[0]), key=lambda h: h[:2], reverse=True)[:2]
    for _, _, c in best:
        for node in sorted(sorted(groups[c]), key=lambda v: len(near.get(v, ())), reverse=True)[:3]:
            if node not in out:
                out.append(node)
    return out[:6]


def plain_paths(edges, starts, longest, words):
    near, found = neighbours(edges), {}

    def visit(path, total):
        if len(path) > 1:
            name = set(" ".join(path).lower().split())
            score = round(total + 0.15 * (len(path) - 1) + 0.2 * len(name & set(words)), 6)
            found[path] = max(found.get(path, 0), score)
        if len(path) <= longest:
            for node, c, _ in near.get(path[-1], ()):
                if node not in path:
                    visit((*path, node), total + c)

    for s in starts:
        visit((s,), 0.0)
    return sorted(((list(p), len(p) - 1, s) for p, s in found.items()), key=lambda r: (-r[1], -r[2], r[0]))[:6]


def test_hybrid_equals_plain_python(spark):
    rng = random.Random(6)
    for n in (10, 40, 90):
        edges = random_graph(rng, 30, n)
        groups = defaultdict(list)
        for k in range(30):
            groups[f"c{k % 5 if k % 2 else 7}"].append(f"n{k:02d}")
        seeds = rng.sample([f"n{k:02d}" for k in range(30)], 3)
        df, given = spark.createDataFrame(edges, SCHEMA), spark.createDataFrame(list(enumerate(seeds)), "place int, node string")
        members = spark.createDataFrame([(v, c) for c, some in groups.items() for v in some], "node string, community string")
        want = plain_primers(edges, seeds, groups)
        assert [r["node"] for r in G.primers(df, given, members).orderBy("place").collect()] == want
        paths = plain_paths(edges, want, 2, ("n03", "n11"))
        found = G.hybrid(df, given, members, ("n03", "n11"))
        assert [(r["path"], r["n_edges"], r["score"]) for r in found.collect()] == paths
        assert [r["node"] for r in G.selected(found, 4).orderBy("place").collect()] == list(dict.fromkeys(v for p, _, _ in paths for v in p))[:4]
