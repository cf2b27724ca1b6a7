"""Shortest paths with their nodes, and walks over a network of its own."""

from __future__ import annotations

import heapq
import math
import random

from waymark.operators import access, graph


def dijkstra(arcs, source):
    best, prev, heap = {}, {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        heap_in = [(d + w, v) for v, w in arcs.get(u, []) if v not in best]
        for item in heap_in:
            heapq.heappush(heap, item)
    for v, d in best.items():
        prev[v] = min((u for u in best for t, w in arcs.get(u, []) if t == v and best[u] + w == d and best[u] < d), default=None)
    return best, prev


def test_paths_are_those_of_dijkstra(spark):
    rng = random.Random(2)
    edges = [(i, i + 1, 1.0) for i in range(20)] + [(rng.randrange(21), rng.randrange(21), rng.choice([1.0, 2.0, 5.0, 7.5])) for _ in range(12)] + [(50, 51, 1.0), (3, 3, 1.0)]
    arcs = {}
    for a, b, w in edges:
        if a != b:
            w = min(x for s, t, x in edges if {s, t} == {a, b})
            arcs.setdefault(a, set()).add((b, w))
            arcs.setdefault(b, set()).add((a, w))
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    trees = graph.path_trees(df, graph.shortest_paths(df, spark.createDataFrame([(0,), (9,), (50,)], "source long")))
    got = {}
    for r in graph.unrolled(trees, trees.select("source", "node")).orderBy("source", "node", "pos").collect():
        got.setdefault((r["source"], r["node"]), []).append(r["at"])
    for s in (0, 9, 50):
        best, prev = dijkstra(arcs, s)
        assert {n for t, n in got if t == s} == set(best)
        for n in best:
            path = [n]
            while path[-1] != s:
                path.append(prev[path[-1]])
            assert got[s, n] == path


def test_places_that_are_no_numbers_have_no_nearest(spark):
    rows = [(1, 0.0, 0.0), (2, math.nan, 0.0), (3, math.inf, 1.0), (4, None, 1.0), (5, 1e7, 0.0)]
    left = spark.createDataFrame(rows, "v long, x double, y double")
    right = spark.createDataFrame([(7, 1.0, 0.0), (8, math.nan, math.nan)], "n long, x double, y double")
    assert sorted((r["v"], r["n"]) for r in access.nearest_any(left, right, "v", "n").collect()) == [(1, 7), (5, 7)]


def test_walks_take_the_paths_and_not_the_roads(spark):
    xy = "x double, y double"
    villages = spark.createDataFrame([(1, 3000.0, 100.0, False), (2, 9000.0, 9000.0, None)], f"village long, {xy}, foot_only boolean")
    roads = spark.createDataFrame([(10, 0.0, 5000.0), (11, 6000.0, 5000.0)], f"node long, {xy}")
    road = spark.createDataFrame([(10, 11, 6.0)], "src long, dst long, weight double")
    stops = spark.createDataFrame([(70, 0.0, 0.0, False)], f"stop long, {xy}, track_only boolean")
    paths = spark.createDataFrame([(20, 3000.0, 0.0), (21, 0.0, 0.5)], f"node long, {xy}")
    path = spark.createDataFrame([(20, 21, 3.0)], "src long, dst long, weight double")
    up = spark.createDataFrame([(0, c, float(c) * 10) for c in range(4)], "row int, col int, z double")
    ground = access.Ground(up, (0.0, 20000.0, 1000.0, 1, 4))
    rows = {r["village"]: r for r in access.access_tables(villages, roads, road, stops, (False,), paths, path, ground).collect()}
    assert rows[1]["walk_basis"] == "path network" and rows[1]["road_reachable"] == "no" and rows[2]["walk_basis"] == "straight line"
    assert rows[1]["walk_hours"] < rows[1]["walk_hours_back"]  # down to the stop, up from it
    level = {r["village"]: r for r in access.access_tables(villages, roads, road, stops, (False,), paths, path).collect()}
    assert level[1]["walk_hours"] == round(3.1 / (6 * math.exp(-0.175)), 2) == level[1]["walk_hours_back"]
    # on the road network the same place walks straight
    assert {r["village"]: r["walk_basis"] for r in access.road_access(villages, roads, road, stops).collect()} == {1: "straight line", 2: "straight line"}
