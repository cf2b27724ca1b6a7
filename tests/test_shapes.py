"""Line, resolution and fit operators on small hand-made inputs."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from waymark.functions import text as tx
from waymark.operators import lines as ln
from waymark.operators import resolve


def points(spark, lines):
    return spark.createDataFrame([(i, k, float(x), float(y)) for i, pts in lines.items() for k, (x, y) in enumerate(pts)], "line_id long, seq int, x double, y double")


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_noding_splits_crossings_touches_and_overlaps(spark):
    net = points(spark, {1: [(0, 0), (100, 0)], 2: [(50, -50), (50, 50)], 3: [(20, 0), (20, 40)], 4: [(60, 0), (140, 0)], 5: [(300, 0), (300, 0.02)]})
    got = {((r["src_x"], r["src_y"]), (r["dst_x"], r["dst_y"])) for r in ln.noded(net).collect()}
    on_axis = [0.0, 20.0, 50.0, 60.0, 100.0, 140.0]
    want = {((a, 0.0), (b, 0.0)) for a, b in zip(on_axis, on_axis[1:], strict=False)} | {((50.0, -50.0), (50.0, 0.0)), ((50.0, 0.0), (50.0, 50.0)), ((20.0, 0.0), (20.0, 40.0))}
    assert got == want


def test_densify_hits_both_ends_and_even_steps(spark):
    rows = ln.densify(points(spark, {1: [(0, 0), (3, 0), (3, 7)]}), 5).orderBy("k").collect()
    assert [(round(r["x"], 6), round(r["y"], 6)) for r in rows] == [(0, 0), (2.5, 0), (3, 2), (3, 4.5), (3, 7)]


def test_overlap_share(spark):
    lines = points(spark, {1: [(0, 0), (1000, 0)], 2: [(0, 5000), (1000, 5000)]})
    got = {r["line_id"]: r["share"] for r in ln.overlap_share(lines, points(spark, {9: [(0, 100), (490, 100)]}), n=11, reach=150.0).collect()}
    assert math.isclose(got[1], 7 / 11) and got[2] == 0.0


def test_covered_lines_go(spark):
    lines = points(spark, {1: [(0, 0), (1000, 0)], 2: [(0, 10), (500, 10)], 3: [(0, 10), (0, 400)]})
    got = {r["line_id"]: r["kept_m"] for r in ln.covered_last(lines).collect()}
    assert set(got) == {1, 3} and got[1] == 1000 and 340 < got[3] < 390


def test_simplify_keeps_corners(spark):
    rows = ln.simplify(points(spark, {1: [(0, 0), (50, 1), (100, 0), (100, 80)]}), 25.0).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [0, 2, 3]


def test_voronoi_cells_fill_the_hull():
    hull = [(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0)]
    cells = ln.voronoi_cells([(1, 2.0, 2.0), (2, 8.0, 3.0), (3, 5.0, 7.0), (4, 2.0, 2.0)], hull)
    assert cells[4] == [] and math.isclose(sum(area(c) for c in cells.values() if c), 80.0)


def test_greedy_merge_measures_from_the_seed(spark):
    rows = [(1, "a", 0.0, 0.0, 1), (2, "a", 2900.0, 0.0, 2), (3, "a", 5800.0, 0.0, 4), (4, "b", 0.0, 0.0, 8), (5, "a", 0.0, 0.0, 1)]
    got = sorted(tuple(r) for r in resolve.merge_same_name(spark.createDataFrame(rows, "id long, name string, x double, y double, n long")).collect())
    assert got == [(1, "a", 1450.0, 0.0, 4, 3), (3, "a", 5800.0, 0.0, 4, 1), (4, "b", 0.0, 0.0, 8, 1)]


def test_seeds_are_those_of_the_loop(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.uniform(0, 12_000), rng.uniform(0, 9_000)) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000 + i, "line", 1500.0 * i, 0.0) for i in range(15)] + [(30_000 + i, "spot", 5.0 + i % 3, 5.0) for i in range(60)]
    rows += [(40_000, "a", None, 0.0), (40_001, "a", float("nan"), 0.0)]
    seeds, want = [], {}
    for i, name, x, y in sorted(rows, key=lambda r: r[0]):
        ok = x is not None and x == x
        own = next((s for s, n, a, b in seeds if ok and n == name and math.hypot(x - a, y - b) <= 3000.0), None)
        want[i] = own if own is not None else i
        if own is None and ok:
            seeds.append((i, name, x, y))
    got = resolve.greedy_seeds(spark.createDataFrame(rows, "id long, name string, x double, y double").repartition(5), 3000.0)
    assert {r["id"]: r["seed"] for r in got.collect()} == want


def test_spelling_groups_and_distance_veto(spark):
    rows = [("k", "kiara", 0.0, 0.0), ("k", "kiera", 100.0, 0.0), ("k", "kieraa", 90000.0, 0.0), ("k", "zzz", None, None)]
    got = dict(tuple(r) for r in resolve.spelling_groups(spark.createDataFrame(rows, "block string, name string, x double, y double")).collect())
    assert got == {"kiara": "kiara", "kiera": "kiara", "kieraa": "kieraa", "zzz": "zzz"}


def test_anchors_spread_round_by_round(spark):
    unknown = spark.createDataFrame([("b",), ("c",), ("z",)], "name string")
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    known = spark.createDataFrame([("a", 1.0, 2.0)], "name string, x double, y double")
    assert sorted(tuple(r) for r in resolve.propagate_anchors(unknown, links, known, 3).collect()) == [("b", 1.0, 2.0, 1), ("c", 1.0, 2.0, 2)]


def test_tour_visits_all_and_untangles(spark):
    rows = [("g", n, x, y, None) for n, x, y in (("a", 0.0, 0.0), ("b", 10.0, 10.0), ("c", 10.0, 0.0), ("d", 0.0, 10.0))]
    got = [r["name"] for r in resolve.open_tour(spark.createDataFrame(rows, "g string, name string, x double, y double, job int"), "g").orderBy("place").collect()]
    assert got[0] == "a" and sorted(got) == list("abcd") and got in (list("acbd"), list("adbc"))


def test_affine_fit_drops_outliers(spark):
    rows = [(float(x), float(y), 2.0 + 3 * x - y) for x in range(8) for y in range(8)] + [(3.0, 3.0, 900.0)]
    (a, b, c), rms, n = resolve.affine_fit(spark.createDataFrame(rows, "x double, y double, v double"))
    assert n == 64 and rms < 1e-9 and max(abs(a - 2), abs(b - 3), abs(c + 1)) < 1e-9


def test_grid_sample_clips(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(2) for c in range(3)], "row int, col int, z double")
    pts = spark.createDataFrame([(-5.0, 9.0), (1.5, 0.5), (99.0, -99.0)], "x double, y double")
    assert sorted(r["z"] for r in resolve.sample_grid(pts, cells, 0.0, 2.0, 1.0, 1.0, 3, 2).collect()) == [0.0, 11.0, 12.0]


def test_added_text():
    assert resolve.added_text("the old note", "the very old note ends") == "very ends" and resolve.added_text(None, "x y") == "x y" and resolve.added_text("x", None) == ""


def test_text_rules(spark):
    rows = spark.createDataFrame([("Saved track 3", 1500), (" 2024-01-05 10:22 Walk to X. ", 12), (None, 5 * 1024**2)], "t string, n long")
    got = rows.select(tx.clean_name(F.col("t"), F.lit("fallback")).alias("c"), tx.squeeze(F.col("t")).alias("s"), tx.human_bytes(F.col("n")).alias("h"), tx.sequence_ratio(F.col("t"), F.lit("Walk to X")).alias("r")).collect()
    assert [r["c"] for r in got] == ["fallback", "Walk to X", "fallback"] and [r["h"] for r in got] == ["1.5 KB", "12 B", "5.0 MB"] and got[2]["r"] == 0.0 and got[1]["s"] == "ualktox"


def test_zone_of_lines_by_pieces(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (6.0, 10.0), (6.0, 4.0), (4.0, 4.0), (4.0, 10.0), (0.0, 10.0)]  # with a notch from above
    lines = {1: [(1, 1), (9, 1)], 2: [(-5, 5), (-1, 20)], 3: [(-1, 2), (11, 3)], 4: [(2, 8), (8, 8)], 5: [(5, 6)], 6: [(2, 2)], 7: [(-1, 0), (1, -2)], 8: [(-1, 1), (1, -1)], 9: [(4.5, 8), (5.5, 9)]}
    points = spark.createDataFrame([(k, i, float(x), float(y)) for k, v in lines.items() for i, (x, y) in enumerate(v)], "line_id long, seq long, x double, y double")
    got = {r["line_id"]: r["zone"] for r in ln.zone_of_lines(points, ring).collect()}
    assert got == {1: "inside", 2: "outside", 3: "crossing", 4: "crossing", 5: "outside", 6: "inside", 7: "outside", 8: "crossing", 9: "outside"}
