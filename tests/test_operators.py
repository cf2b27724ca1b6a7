"""Operators on small hand-made inputs."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import graph, spatial
from waymark.operators import trajectory as tr


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def test_speed_class_edges(spark):
    rows = spark.createDataFrame([(11.0, 0.0), (4.5, 0.0), (4.6, 0.0), (3.0, 0.25), (None, None)], "m double, f double")
    assert [r[0] for r in rows.select(geo.speed_class(F.col("m"), F.col("f"))).collect()] == ["Motor", "Foot", None, "Motor", None]


def test_access_class_edges(spark):
    rows = spark.createDataFrame([(2500.0,), (2500.1,), (10000.0,), (10000.1,), (None,)], "m double")
    assert [r[0] for r in rows.select(geo.access_class(F.col("m"))).collect()] == ["near", "long walk", "long walk", "beyond", None]


def test_utm_on_the_meridian(spark):
    east, north = geo.utm(F.lit(-9.143), F.lit(147.0))
    e, n = spark.range(1).select(east, north).first()
    assert abs(e - 500000) < 1e-6 and 8_980_000 < n < 8_995_000


def test_gap_of_exactly_the_limit_stays(spark):
    pts = spark.createDataFrame([("a", 0.0), ("a", 600.0), ("a", 1201.0)], "run string, epoch double")
    out = tr.gap_sessions(pts, "run", ["epoch"], least=1).orderBy("session").collect()
    assert [r["n"] for r in out] == [2, 1]


def test_steps_of_zero_time_have_no_speed(spark):
    pts = spark.createDataFrame([("a", 1, 0.0, 0.0, 5.0), ("a", 2, 0.0, 0.1, 5.0)], "run string, seq int, lat double, lon double, epoch double")
    rows = tr.steps(pts, "run", ["seq"]).orderBy("seq").collect()
    assert rows[0]["kmh"] is None and rows[1]["kmh"] is None


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([(float(i // 2), float(-(i // 2))) for i in range(20)] + [(None, 1.0)], "x double, y double")
    n, rho = tr.spearman(rows, "x", "y").first()
    assert n == 20 and abs(rho + 1) < 1e-12
    assert tr.spearman(rows.limit(5), "x", "y").first()["rho"] is None


def test_nearest_keeps_ties(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "a long, x double, y double")
    b = spark.createDataFrame([(5, 3.0, 4.0), (6, -3.0, 4.0), (7, 60.0, 0.0)], "b long, x double, y double")
    assert sorted(r["b"] for r in spatial.nearest_within(a, b, "a", "b", ("x", "y"), ("x", "y"), 10.0).collect()) == [5, 6]
    assert spatial.nearest_within(a, b, "a", "b", ("x", "y"), ("x", "y"), 10.0, ties=False).first()["b"] == 5


def test_components_are_least_members(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60), 1.0) for _ in range(45)]
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in rows:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.connected_components(edges_of(spark, rows)).collect()}
    assert got == {i: find(i) for a, b, _ in rows if a != b for i in (a, b)}


def test_spanning_forest_is_kruskals(spark):
    rng = random.Random(5)
    rows = [(a, b, float(rng.randrange(9))) for a, b in combinations(range(18), 2) if rng.random() < 0.2]
    parent, want = list(range(18)), set()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b, w))
    nodes = spark.range(18).withColumnRenamed("id", "node")
    assert {tuple(r) for r in graph.spanning_forest(edges_of(spark, rows), nodes).collect()} == want


def test_shortest_paths_and_limit(spark):
    rows = [(0, 1, 2.0), (1, 2, 2.0), (0, 2, 5.0), (2, 3, 1.0), (8, 9, 1.0)]
    source = spark.createDataFrame([(0,)], "source long")
    got = {r["node"]: r["km"] for r in graph.shortest_paths(edges_of(spark, rows), source).collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 4.0, 3: 5.0}
    assert {r["node"] for r in graph.shortest_paths(edges_of(spark, rows), source, limit=4.0).collect()} == {0, 1, 2}


def test_leg_status_branches(spark):
    from waymark.plans.reconcile import leg_status_of

    rows = [
        (None, 900.0, 0.0, 0.0, "unlocated"), (150.0, None, 500.0, 500.0, "recorded"), (150.0, 160.0, 501.0, 0.0, "missing"), (3000.0, None, 10.0, 10.0, "missing"),
        (2500.0, 6250.0, 0.0, 0.0, "recorded"), (2501.0, 6250.0, 0.0, 0.0, "partial"), (3000.0, 5400.0, 0.0, 0.0, "recorded"), (3000.0, 3000.0, 10.0, 501.0, "partial"), (3000.0, 3000.0, 900.0, 501.0, "missing"),
    ]
    df = spark.createDataFrame(rows, "s double, r double, a double, b double, want string")
    got = df.select("want", leg_status_of(F.col("s"), F.col("r"), F.col("a"), F.col("b")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_ranks_over_ranges(spark):
    from waymark.operators.trajectory import average_ranks

    values = [i * 7 % 301 / 3 for i in range(900)] + [5.0] * 40
    got = {(r["v"], r["rank"]) for r in average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "rank").collect()}
    order = sorted(values)
    assert got == {(v, order.index(v) + 1 + (order.count(v) - 1) / 2) for v in values}
    assert average_ranks(spark.createDataFrame([], "v double"), "v", "rank").count() == 0
