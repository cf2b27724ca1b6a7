"""Distance joins on places that many rows share, against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import access, linear, lines, spatial


def rows_joined(df) -> int:
    """The most rows that any join of the plan has put out."""
    df.collect()
    text, most = [df._jdf.queryExecution().executedPlan()], 0
    while text:
        p = text.pop()
        if "Join" in p.nodeName():
            m = p.metrics().get("numOutputRows")
            most = max(most, m.get().value() if m.isDefined() else 0)
        kids = p.children() if not p.nodeName().startswith("AdaptiveSparkPlan") else None
        if kids is None:
            text.append(p.executedPlan())
        else:
            text += [kids.apply(i) for i in range(kids.size())]
            if "QueryStage" in p.nodeName():
                text.append(p.plan())
    return most


def most_sent(df) -> int:
    """The most bytes that any exchange of the plan has sent."""
    df.collect()
    text, most = [df._jdf.queryExecution().executedPlan()], 0
    while text:
        p = text.pop()
        if p.nodeName() == "Exchange":
            m = p.metrics().get("dataSize")
            most = max(most, m.get().value() if m.isDefined() else 0)
        kids = p.children() if not p.nodeName().startswith("AdaptiveSparkPlan") else None
        if kids is None:
            text.append(p.executedPlan())
        else:
            text += [kids.apply(i) for i in range(kids.size())]
            if "QueryStage" in p.nodeName():
                text.append(p.plan())
    return most


@pytest.fixture
def crowd():
    rng = random.Random(5)
    spots = [(rng.randint(0, 60) * 1.0, rng.randint(0, 60) * 1.0) for _ in range(60)]
    return [(k, *spots[k % 60]) for k in range(300)], [(1000 + k, *spots[(k * 7 + 3) % 30]) for k in range(120)] + [(5000, 400.0, 400.0), (5001, None, 1.0)]


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("cap", [3.0, 45.0, 900.0])
def test_nearest_within_is_that_of_a_loop(spark, crowd, ties, cap):
    left, right = crowd[0] + [(900, 395.0, 399.0), (901, float("nan"), 0.0)], crowd[1]
    a, b = spark.createDataFrame(left, "a long, x double, y double"), spark.createDataFrame(right, "b long, x double, y double")
    got = sorted((r["a"], r["b"], r["d"]) for r in spatial.nearest_within(a, b, "a", "b", ("x", "y"), ("x", "y"), cap, ties).collect())
    want = []
    for k, x, y in left:
        gaps = sorted((math.hypot(u - x, v - y), r) for r, u, v in right if u is not None)
        near = [(d, r) for d, r in gaps if d <= cap and d == gaps[0][0]]
        want += [(k, r, d) for d, r in (near if ties else near[:1])]
    assert got == sorted(want)


def test_a_wide_cap_does_not_pair_all(spark):
    side = [(k * 40 + j, k * 10.0, j * 10.0) for k in range(40) for j in range(40)]
    a, b = spark.createDataFrame(side, "a long, x double, y double"), spark.createDataFrame(side, "b long, x double, y double")
    own = spatial.nearest_in
    try:
        looked = []
        spatial.nearest_in = lambda left, right, lk, rk, lxy, rxy, cap, ties=True: looked.append(cap) or own(left, right, lk, rk, lxy, rxy, cap, ties)
        assert spatial.nearest_within(a, b, "a", "b", ("x", "y"), ("x", "y"), 400.0).count() == 1600
    finally:
        spatial.nearest_in = own
    # before, one look took in all 1,600 places at 400 m
    assert max(looked) < 30


def test_clusters_are_those_of_a_loop(spark):
    rng = random.Random(2)
    pts = [(k, rng.choice((0, 300, 700)) + rng.random() * 90, rng.random() * 90) for k in range(90)] + [(200 + k, 500.0, 500.0) for k in range(5)] + [(300, 520.0, 500.0)]
    for radius in (6.0, 20.0, 250.0, 1000.0):
        rest, want = {p[0] for p in pts}, {}
        at = {p[0]: p[1:] for p in pts}
        while rest:
            first = min(rest)
            todo, rest = [first], rest - {first}
            while todo:
                n = todo.pop()
                want[n] = first
                near = [m for m in rest if math.hypot(at[m][0] - at[n][0], at[m][1] - at[n][1]) <= radius]
                todo, rest = todo + near, rest - set(near)
        got = spatial.radius_clusters(spark.createDataFrame(pts, "k long, x double, y double"), "k", "x", "y", radius)
        assert {r["node"]: r["component"] for r in got.collect()} == want


def test_only_pairs_of_two_components_meet(spark):
    pts = [(k, float(k % 20), float(k // 20), 0 if k < 399 else 399) for k in range(400)]
    met = spatial.cross_pairs(spark.createDataFrame(pts, "node long, x double, y double, component long"), 50.0)
    assert met.select("a", "b").distinct().count() == 399 and rows_joined(met) <= 1000


def test_boxes_expand_classes_inside_a_task(spark):
    rows = [(k, "ab"[k % 2] if k % 7 else None, float(k % 3) * 100, 0.0) for k in range(600)]
    df = spatial.box_pairs(spark.createDataFrame(rows, "k long, n string, x double, y double"), "k", "n", "x", "y", 150.0)
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1] and a[1] != b[1] and abs(a[2] - b[2]) < 150)
    assert sorted((r["a"], r["b"]) for r in df.collect()) == want
    # before, the join put out a row for each pair
    assert rows_joined(df) < 600 < len(want)


def test_a_hot_place_is_paired_in_parts(spark, monkeypatch):
    for name, value in (("PACK", 20), ("PART", 50), ("FEW", 7)):
        monkeypatch.setattr(spatial, name, value)
    # tiles of 40 m, also left of zero; places half a box off meet from tile to tile; two names share some keys
    rows = [(k, "ab"[k % 2], 39.0, -1.0) for k in range(150)] + [(200 + k, "abc"[k % 3], k % 23 * 10.0 - 80, k % 7 * 8.5 - 20) for k in range(200)] + [(k, "c", 40.0, 0.0) for k in range(9)]
    df = spatial.box_pairs(spark.createDataFrame(rows, "k long, n string, x double, y double"), "k", "n", "x", "y", 10.0)
    want = [tuple(sorted((a[0], b[0]))) for i, a in enumerate(rows) for b in rows[:i] if a[0] != b[0] and a[1] != b[1] and abs(a[2] - b[2]) < 10 and abs(a[3] - b[3]) < 10]
    assert sorted((r["a"], r["b"]) for r in df.collect()) == sorted(want) and len(want) > 5000


def test_a_class_is_not_shuffled_for_each_of_its_partners(spark):
    rows = [(k, f"n{k % 10}", k // 10 % 10 * 10.0, 0.0) for k in range(3000)]
    df = spatial.box_pairs(spark.createDataFrame(rows, "k long, n string, x double, y double"), "k", "n", "x", "y", 250.0).agg(F.count("*"))
    # small tables would be broadcast, large ones are not
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        # before, a class's list of members was sent to each of its 90 partners
        assert 0 < most_sent(df) < 600_000 and df.first()[0] == 3000 * 2700 // 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bridges_are_those_of_sorted_pairs(spark):
    rng = random.Random(8)
    spots = [(rng.randint(0, 9) * 3.0, rng.randint(0, 9) * 4.0) for _ in range(24)] + [(400.0, 0.0), (430.0, 0.0), (400.0, 1.0), (430.0, 2.0)]
    nodes = [(k, *p) for k, p in enumerate(spots + spots[:8])]
    edges = [(k, k + 1, 1.0) for k in range(0, len(nodes), 2)]
    for gap in (0.5, 6.0, 60.0, 5000.0):
        pairs = sorted((math.hypot(p[1] - q[1], p[2] - q[2]), p[0] // 2, q[0] // 2, p[0], q[0]) for p in nodes for q in nodes if p[0] // 2 < q[0] // 2)
        best, part, want = {}, list(range(len(edges))), []
        for d, a, b, p, q in pairs:
            best.setdefault((a, b), (d, p, q))
        for (a, b), (d, p, q) in sorted(best.items(), key=lambda e: (e[1][0], e[0])):
            if d <= gap and part[a] != part[b]:
                want.append((p, q, d))
                part = [part[a] if c == part[b] else c for c in part]
        got = access.bridge_gaps(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(nodes, "node long, x double, y double"), gap)
        assert sorted((r["a"], r["b"], r["weight"]) for r in got.collect()) == sorted(want)


def test_near_lines_are_those_of_a_loop(spark):
    rng = random.Random(4)
    segs = [(k, i, rng.random() * 900, rng.random() * 900) for k in range(6) for i in range(3)] + [(9, 0, 400.0, 0.0), (9, 1, 400.0, 800.0)]
    at = [(k, k % 7, rng.random() * 1400 - 200, rng.random() * 1400 - 200) for k in range(400)]
    got = lines.near_lines(spark.createDataFrame(at, "line_id long, k int, x double, y double"), spark.createDataFrame(segs, "line_id long, seq long, x double, y double"), 60.0)

    def off(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - x1 - t * dx, y - y1 - t * dy)

    pieces = [(*a[2:], *b[2:]) for a, b in zip(segs, segs[1:], strict=False) if a[0] == b[0]]
    assert sorted(r["line_id"] for r in got.collect()) == [k for k, _, x, y in at if min(off(x, y, *p) for p in pieces) <= 60]


def test_dense_lines_decide_cells_without_pairs(spark):
    """Before, 900 points met each of 200 lines around them."""
    segs = [(k, i, k * 3.0, i * 600.0) for k in range(200) for i in range(2)]
    at = [(k, 0, 10.0 + k % 30 * 19, 10.0 + k // 30 * 19) for k in range(900)]
    got = lines.near_lines(spark.createDataFrame(at, "line_id long, k int, x double, y double"), spark.createDataFrame(segs, "line_id long, seq long, x double, y double"), 60.0)
    assert got.count() == 900 and rows_joined(got) <= 1000


def test_cells_of_a_long_line_follow_it(spark):
    s = spark.createDataFrame([(0.0, 0.0, 10_000.0, 9_000.0), (50.0, 20.0, 50.0, 20.0), (30.0, 0.0, 30.0, 95.0), (-15.0, 42.0, -99.0, 42.0)], "x1 double, y1 double, x2 double, y2 double")
    for reach in (0.0, 3.0, 12.0):
        got = {(r["x1"], r["y1"], r["cx"], r["cy"]) for r in spatial.over_cells(s, reach, 10.0).collect()}
        for x1, y1, x2, y2 in s.collect():
            for i in range(4001):
                x, y = x1 + (x2 - x1) * i / 4000, y1 + (y2 - y1) * i / 4000
                for dx, dy in ((0, 0), (reach, 0), (-reach, 0), (0, reach), (0, -reach)):
                    assert (x1, y1, math.floor((x + dx) / 10), math.floor((y + dy) / 10)) in got
        assert len(got) < 12_000  # the box of the long one has 900,000


def test_pieces_in_a_dense_place_are_looked_up_near_by(spark):
    """Before, a place met every piece within the cap; the nearest and its ties are the same."""
    pieces = [(k, 0, i, k * 10.0, i * 2000.0) for k in range(200) for i in range(2)]
    at = [(k, 5.0 + k * 10.0 if k % 2 else k * 10.0 + 1, 400.0 + k) for k in range(0, 190)] * 1 + [(500, 6000.0, 0.0), (501, 2090.0, 1000.0)]
    got = linear.nearest_piece(spark.createDataFrame(at, "p long, x double, y double"), "p", spark.createDataFrame(pieces, "line_id long, chunk long, seq long, x double, y double"), 400.0)
    want = [(k, k, 1.0) for k in range(0, 190, 2)] + [(k, line, 5.0) for k in range(1, 190, 2) for line in (k, k + 1)] + [(501, 199, 100.0)]
    assert sorted((r["p"], r["line_id"], round(r["d"], 9)) for r in got.collect()) == sorted(want)


def test_noding_does_not_broadcast_cells(spark):
    pts = [(k, i, float(i * 3000 + k), float(k * 40 if i else 3000 - k * 40)) for k in range(60) for i in range(2)]
    net = lines.noded(spark.createDataFrame(pts, "line_id long, seq long, x double, y double"))
    plan = net._jdf.queryExecution().executedPlan().toString()
    # before, the exploded cells were broadcast by the size of the few segments that make them
    assert "BroadcastHashJoin" not in plan.split("Generate")[1] and net.count() > 60


def test_totals_of_a_network_are_those_of_its_edges(spark):
    rng = random.Random(4)
    at = lambda: (rng.randint(-60, 60) / 2, rng.randint(-60, 60) / 2)
    pts = [(k, i, *at()) for k in range(12) for i in range(5)]
    # overlaps, one of them backwards, lines along the tiles' sides, a twin, a touch, a line without a length, and one that has no place
    more = [[(-30, 20), (30, 20)], [(25, 20), (-5, 20)], [(20, -30), (20, 31)], [(20, 31), (20, 3)], [(-7.03, 20.04), (-7, -9)], [(1, 1), (1, 1)], [(0.05, 0.15), (0.25, 17.35)], [(3, 4), (math.nan, 1)], [(3, 4), (None, 1)]]
    pts += [(20 + k, i, *map(lambda v: v if v is None else float(v), p)) for k, line in enumerate(more) for i, p in enumerate(line)] + [(40, i, x, y) for k, i, x, y in pts if k == 3]
    df = spark.createDataFrame(pts, "line_id long, seq long, x double, y double")
    want = lines.noded(df.where("line_id not in (27, 28)"), 20.0).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    for size in (10.0, 20.0, 250.0):
        got = lines.noded_total(df, size).first()
        assert got["edges"] == want["n"] > 500 and math.isclose(got["weight"], want["w"])
    assert tuple(lines.noded_total(df.limit(0)).first()) == (0, None)


def test_blocks_of_a_tile_give_its_edges_once(monkeypatch):
    rng = np.random.default_rng(5)
    ends = rng.integers(-100, 200, (4, 90)) / 4.0
    ends = np.concatenate([ends, ends[:, :30]], axis=1)
    whole, parts = lines.tile_nodes(0, 0, *ends, 25.0, 10.0)
    monkeypatch.setattr(lines, "BLOCK", 500)
    blocks, more = lines.tile_nodes(0, 0, *ends, 25.0, 10.0)
    assert whole[0] == blocks[0] > 100 and math.isclose(whole[1], blocks[1]) and len(more) > len(parts) == 1
    assert all((np.concatenate(b) == a).all() for a, b in zip(parts[0], zip(*more, strict=True), strict=True))


def test_rounding_in_tiles_is_that_of_bround(spark):
    v = [0.05, 0.15, 0.25, -0.05, -0.15, 13107.65, 13107.75, 2.675, 1.005, 12.299999999999999, 12.3, 0.049999999999999996, 0.15000000000000002, 9.95, -9.95, 20010.0]
    for digits in (1, 2):
        want = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").select(F.bround("x", digits)).collect()]
        assert (lines.rounded(np.array(v), 10.0**digits) / 10.0**digits).tolist() == want


def test_a_network_makes_no_row_for_a_crossing(spark, tmp_path):
    from waymark.plans.shapes import network_nodes

    spark.range(1000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    # before, the join put out a row for each pair of segments in a cell
    df = network_nodes(spark, str(tmp_path))
    assert rows_joined(df) <= 1000 and df.first()["edges"] > 10_000


def test_greatest_within_is_that_of_a_loop(spark):
    rng = random.Random(8)
    left = [(k, rng.choice("abc"), rng.uniform(0, 90), rng.uniform(0, 90)) for k in range(300)] + [(900, "a", None, 1.0), (901, "d", 1.0, 1.0), (902, "e", 39.0, 1.0)]
    right = [(rng.choice("ab"), k, rng.randint(0, 90) * 1.0, rng.randint(0, 90) * 1.0) for k in range(150)] + [("c", 500, 10.0, 10.0), ("a", None, 1.0, 1.0), ("a", 999, float("nan"), 1.0), ("e", 7, 9.0, 1.0)]
    a, b = spark.createDataFrame(left, "a long, n string, x double, y double"), spark.createDataFrame(right, "n string, k long, x double, y double")
    got = {(r["a"], r["k"]) for r in spatial.greatest_within(a, b, "a", "n", "k", 30.0).collect()}
    best = {i: max((k for m, k, u, v in right if m == n and k is not None and u == u and math.hypot(u - x, v - y) <= 30), default=None) for i, n, x, y in left if x is not None}
    assert got == {(i, k) for i, k in best.items() if k is not None} and (902, 7) in got


def test_an_event_meets_few_places_of_its_name(spark, tmp_path):
    from waymark.plans.shapes import owner_by_name_or_place

    spark.range(1000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(100_000).select(F.col("id").alias("event_id"), (F.col("id") % 100).alias("user_id"), F.lit("t").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    # each name has 25 places, and some 13 of them within reach
    assert rows_joined(owner_by_name_or_place(spark, str(tmp_path))) <= 150_000
