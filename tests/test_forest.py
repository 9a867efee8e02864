"""Rooted forests, bridges and shortest paths against walks and Dijkstra's algorithm."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.kit import forest
from tidemark.kit.graph import bfs, root_sums
from tidemark.operators import network


def dijkstra(adj, start):
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d == dist[u]:
            for v, w in adj[u]:
                if d + w < dist.get(v, float("inf")):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
    return dist


def graph_rows():
    rng, rows = random.Random(1), []
    for c, n in enumerate((25, 9, 14, 2)):
        rows += [(100 * c + k, 100 * c + rng.randrange(k), float(rng.randrange(1, 9))) for k in range(1, n)]
        rows += [(100 * c + rng.randrange(n), 100 * c + rng.randrange(n), float(rng.randrange(0, 9))) for _ in range(3 if c % 2 == 0 else 0)]
    return rows + [(500, 500, 1.0), (None, 3, 1.0)]


def neighbours(rows):
    adj = {}
    for a, b, w in rows:
        if a is not None and b is not None and a != b:
            adj.setdefault(a, []).append((b, w))
            adj.setdefault(b, []).append((a, w))
    return adj


@pytest.fixture(scope="module")
def looped(spark):
    return spark.createDataFrame(graph_rows(), "src long, dst long, w double")


def test_walk_and_distances(looped):
    graph = forest.Graph(forest.simple_edges(looped, "src", "dst", "w"))
    roots = graph.component.groupBy("component").agg(F.max("node").alias("node")).select("node", F.col("component").alias("label"))
    assert sorted(map(tuple, graph.walk(roots).collect())) == sorted(map(tuple, bfs(roots, looped.where("src <> dst")).select("node", "label", "hops", "parent").collect()))
    adj, want = neighbours(graph_rows()), {}
    for r in roots.collect():
        want |= dijkstra(adj, r.node)
    got = graph.distances(graph.seen_from(roots), graph.block_distances())
    assert {r.node: r.distance for r in got.collect()} == want


def test_nearest_seed_is_the_walk(spark, looped):
    seeds = spark.createDataFrame([(3, "x"), (0, "b"), (105, "q"), (200, "z"), (203, "a"), (108, "q"), (9999, "lone")], "node long, label string")
    assert sorted(map(tuple, forest.nearest_seed(seeds, looped).collect())) == sorted(map(tuple, bfs(seeds, looped).select("node", "label", "hops").collect()))


def test_long_path_takes_logarithmic_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    ids = spark.range(1, n).select(((F.col("id") * 7) % n).alias("u"), (((F.col("id") - 1) * 7) % n).alias("v"))
    path = ids.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(0).alias("component"))
    held = forest.settle
    monkeypatch.setattr(forest, "settle", lambda df: rounds.append(df.columns) or held(df))
    seen = forest.orient(path, spark.createDataFrame([(0, 0)], "node long, label long"), nodes)
    assert seen.agg(F.max("depth"), F.sum("size")).first() == (n - 1, n * (n + 1) // 2)
    assert sum(c == ["id", "nx", "left"] for c in rounds) <= 13
    depth = root_sums(seen.withColumn("one", F.lit(1.0)), "node", "parent", "one")
    assert depth.agg(F.max("one")).first()[0] == n


def test_metrics_of_feeders(spark):
    rng, rows = random.Random(2), []
    for f in range(0, 5, 2):
        n = 12 + f
        rows += [(f, f"b{k:02d}", f"b{rng.randrange(k):02d}", float(rng.randrange(0, 9))) for k in range(1, n) if k % 7 != 5]
        rows += [(f, f"b{rng.randrange(n):02d}", f"b{rng.randrange(n):02d}", float(rng.randrange(1, 9))) for _ in range(f)]
    rows += [(6, "x", "x", 1.0), (7, "", "y", 1.0), (8, "p", "q", None), (0, None, "b00", 4.0)]
    got = {r.feeder_id: tuple(r)[1:] for r in network.graph_metrics(spark.createDataFrame(rows, "feeder_id long, from_bus string, to_bus string, length double")).collect()}
    assert set(got) == {0, 2, 4, 6, 7, 8}
    for f in got:
        mine = [(a, b, w or 0.0) for g, a, b, w in rows if g == f and a and b]
        adj = neighbours(mine)
        nodes = {x for a, b, _ in mine for x in (a, b)}
        reach = {x: dijkstra(adj, x) if x in adj else {x: 0.0} for x in nodes}
        best = min((-len(d), min(d)) for d in reach.values())[1] if nodes else None
        inside = sorted(reach[best]) if nodes else []
        sums = [reach[a][b] for a, b in itertools.combinations(inside, 2)]
        far = min((-d, x) for x, d in reach[best].items())[1] if nodes else None
        want = (len(nodes), 2 * sum(g == f for g, *_ in rows) / len(nodes) if nodes else 0.0, sum(sums) / len(sums) if sums else 0.0, max(reach[far].values()) if nodes else 0.0)
        assert got[f] == pytest.approx(want), f
