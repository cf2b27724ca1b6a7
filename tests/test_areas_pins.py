"""Areas, merged runs and field layers on small hand-made inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import areas
from waymark.sources import pins, tracks


def test_shared_edges_dissolve(spark):
    def square(x):
        ring = [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)]
        return [("z", float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]

    out = areas.dissolve(spark.createDataFrame(square(0) + square(1), "zone string, x1 double, y1 double, x2 double, y2 double"), "zone").collect()
    assert len(out) == 6 and not any(r["x1"] == r["x2"] == 1.0 for r in out)


def test_runs_end_at_junctions(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (3, 5, 1.0), (5, 6, 1.0)], "src long, dst long, weight double")
    runs = {}
    for r in areas.merged_runs(e).collect():
        runs.setdefault(r["run"], set()).add((r["src"], r["dst"]))
    assert sorted(map(sorted, runs.values())) == [[(1, 2), (2, 3)], [(3, 4)], [(3, 5), (5, 6)]]


def test_service_runs_do_not_bridge(spark):
    v = spark.createDataFrame([(1, i, k) for i, k in enumerate([1.0, 2.0, 9.0, 2.0, None, 1.0, 1.5, 2.0])], "line_id long, seq int, km double")
    assert sorted((r["n"], r["first"], r["last"]) for r in areas.service_runs(v, 5.0).collect()) == [(2, 0, 1), (3, 5, 7)]


def test_clipping(spark):
    rows = spark.createDataFrame([(-5.0, 5.0, 15.0, 5.0), (2.0, 2.0, 3.0, 3.0), (-5.0, 11.0, 15.0, 11.0), (20.0, -1.0, 20.0, 5.0)], "a double, b double, c double, d double")
    got = [r[0] and tuple(r[0]) for r in rows.select(areas.clipped(*map(F.col, "abcd"), (0.0, 0.0, 10.0, 10.0))).collect()]
    assert got == [(0.0, 5.0, 10.0, 5.0), (2.0, 2.0, 3.0, 3.0), None, None]


def test_centroid_of_distinct_points(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("a", 4.0, 2.0)], "k string, x double, y double")
    r = areas.centroids(rows, "k").first()
    assert (r["x"], r["y"], r["n"], r["max_x"]) == (2.0, 1.0, 2, 4.0)


def test_waypoints(spark):
    note = "<!-- desc_user:start -->Old &amp; <b>closed</b><!-- desc_user:end --> accuracy: 4.5 m <img src=a><IMG src=b>"
    rows = spark.createDataFrame([("School 2024-02-03 10:11", note, " 148.5,-9.25,10 "), ("Gate", None, "1,2"), ("Line", "x", None)], "name string, description string, coordinates string")
    got = [tuple(r) for r in pins.waypoints(rows).collect()]
    assert got == [("Gate", None, 1.0, 2.0, None, None, 0), ("School", "2024-02-03T10:11", 148.5, -9.25, "Old & closed", 4.5, 2)]


def test_pins_keep_their_folder_and_the_last_wins(spark):
    kml = "<kml xmlns='http://x'><Document><name>d</name><Folder><name>PLACE</name><Folder><name>in</name><Placemark><name>A</name><Point><coordinates>1,2,0</coordinates></Point></Placemark></Folder><Placemark><name>A</name><Point><coordinates>3,4</coordinates></Point></Placemark></Folder></Document></kml>"
    rows = pins.pins(spark.createDataFrame([("f", kml)], "path string, kml string"))
    assert sorted((r["folder"], r["lon"]) for r in rows.collect()) == [("/PLACE", 3.0), ("/PLACE/in", 1.0)]
    last = pins.last_pins(rows)
    assert [(r["name"], r["lon"]) for r in last.collect()] == [("A", 3.0)]
    sent = spark.createDataFrame([("A", 3.0, 4.0), ("B", 0.0, 0.0)], "name string, lon double, lat double")
    assert [r["what"] for r in pins.moved_pins(last, sent).collect()] == ["unmoved"] and [r["what"] for r in pins.moved_pins(last, sent.where("name = 'B'")).collect()] == ["new"]


def test_cache_rivers_and_writers(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"osm:Foo: bar":[{"name":"Foo","lat":1.5,"lon":2}],"geo:X":[]}')
    assert [tuple(r) for r in pins.geocode_cache(spark, str(tmp_path / "c.json")).collect()] == [("osm", "Foo: bar", "Foo", 1.5, 2.0)]
    rivers = spark.createDataFrame([(7, 1), (8, 2)], "MAIN_RIV long, id int")
    assert [(r["id"], r["river"]) for r in pins.river_stems(rivers, {7: "Long"}).collect()] == [(1, "Long")]
    pins.write_gpkg([("t", [(1.0, 2.0), (3.0, 4.0)])], str(tmp_path / "o.gpkg"), "tracks")
    pins.write_gpkg([("u", [(5.0, 6.0), (7.0, 8.0)])], str(tmp_path / "o.gpkg"), "tracks")
    assert sorted(r["parts"][0][0]["x"] for r in tracks.gpkg_lines(spark, str(tmp_path / "o.gpkg"), "tracks").collect()) == [1.0, 5.0]
    df = spark.createDataFrame([("a&b", 148.0, -9.0)], "n string, lon double, lat double")
    assert pins.to_gpx_waypoints(df, "n", "lon", "lat").first()[0] == '<wpt lat="-9.000000" lon="148.000000"><name>a&amp;b</name></wpt>'
