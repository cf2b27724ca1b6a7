"""Readers and writers on files made here."""

from __future__ import annotations

import sqlite3
import struct
import zipfile

from pyspark.sql import functions as F

from waymark.sources import tables, tracks
from waymark.streaming import runs

KML = """<kml><Document><Placemark><LineString><coordinates>1,2 3,4,5 bad 6,7</coordinates></LineString></Placemark>
<Placemark><LineString><coordinates>1,2</coordinates></LineString></Placemark>
<gx:Track><when>2024-01-01T00:00:00Z</when><when>oops</when><when>2024-01-01T00:00:20Z</when><gx:coord>148 -9 10</gx:coord><gx:coord>149 -9 10</gx:coord></gx:Track></Document></kml>"""


def test_gpx(spark, tmp_path):
    pts = "".join(f'<trkpt lat="-9.{i:02d}" lon="148.5"><ele>{i}</ele>{f"<time>2024-01-01T00:00:{i:02d}Z</time>" if i != 3 else ""}</trkpt>' for i in range(25))
    (tmp_path / "a.gpx").write_text(f'<gpx><trk><name>t</name><trkseg>{pts}</trkseg><trkseg><trkpt lat="1" lon="2"><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    got = tracks.gpx_points(spark, str(tmp_path / "a.gpx")).orderBy("seq").collect()
    assert len(got) == 24 and got[0]["lat"] == -9.0 and got[-1]["epoch"] - got[0]["epoch"] == 24
    assert str(tracks.gpx_dates(spark, str(tmp_path / "a.gpx")).first()["end_time"]) == "2024-01-01 00:00:24"


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("other.kml", "<kml/>")
        z.writestr("doc.kml", KML)
    docs = tracks.kml_texts(spark, str(tmp_path))
    lines = tracks.kml_lines(docs).collect()
    assert len(lines) == 2 and [tuple(p) for p in lines[0]["points"]] == [(1.0, 2.0), (3.0, 4.0), (6.0, 7.0)]
    assert [(r["lon"], r["seq"]) for r in tracks.gx_tracks(docs.where(F.col("path").endswith(".kml"))).collect()] == [(148.0, 0)]


def line(points, kind=2, order="<", dims=2):
    return struct.pack(order + "BII", order == "<", kind, len(points)) + b"".join(struct.pack(f"{order}{dims}d", *p) for p in points)


def test_wkb_kinds():
    assert tracks.wkb_parts(line([(1, 2), (3, 4)])) == [[(1, 2), (3, 4)]]
    assert tracks.wkb_parts(line([(1, 2, 9), (3, 4, 9)], 1002, ">", 3)) == [[(1, 2), (3, 4)]]
    assert tracks.wkb_parts(line([(1, 2, 9, 8), (3, 4, 9, 8)], 0xC0000002, "<", 4)) == [[(1, 2), (3, 4)]]
    assert tracks.wkb_parts(struct.pack("<BII", 1, 5, 2) + line([(0, 0), (1, 1)]) + line([(5, 5), (6, 6)], order=">")) == [[(0, 0), (1, 1)], [(5, 5), (6, 6)]]
    assert tracks.wkb_parts(struct.pack("<BI2d", 1, 1, 0, 0) + b"\0" * 8) is None


def test_gpkg(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('tracks', 'geom')")
    con.execute("CREATE TABLE tracks (fid INTEGER PRIMARY KEY, geom BLOB)")
    con.execute("INSERT INTO tracks VALUES (1, ?), (2, NULL)", (b"GP\0\x03" + b"\0" * 4 + b"\0" * 32 + line([(1, 2), (3, 4)]),))
    con.commit()
    con.close()
    rows = tracks.gpkg_lines(spark, str(tmp_path / "a.gpkg"), "tracks").collect()
    assert [(r["fid"], [[tuple(p) for p in q] for q in r["parts"]]) for r in rows] == [(1, [[(1.0, 2.0), (3.0, 4.0)]])]
    assert tracks.gpkg_lines(spark, str(tmp_path / "a.gpkg"), "none").count() == 0


def test_geojson_and_kml_writers(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"x"},"geometry":{"type":"Point","coordinates":[1.5,2]}}]}')
    rows = tracks.geojson_features(spark, str(tmp_path / "a.geojson"), "name: STRING").collect()
    assert rows[0]["name"] == "x" and rows[0]["kind"] == "Point" and rows[0]["coordinates"] == "[1.5,2]"
    df = spark.createDataFrame([("a<b", 1.0, 2.0, None)], "name string, x double, y double, note string")
    assert "a&lt;b" in tracks.to_placemarks(df, "name", "x", "y", ["note"]).first()[0] and "Data" not in tracks.to_placemarks(df, "name", "x", "y", ["note"]).first()[0].replace("ExtendedData", "")
    assert '"coordinates":[1.0,2.0]' in tracks.to_geojson(df, "x", "y", ["name"]).first()[0]


def test_commented_csv_drops_and_totals(spark, tmp_path):
    (tmp_path / "waypoints_a.csv").write_text("# from the field\nname,note,lon\nA # 1, n ,148\n# gone\nTotal,,1\n")
    (tmp_path / "waypoints_b.csv").write_text("name,lon\nX,1\n")
    df = tables.drops(spark, str(tmp_path / "waypoints_*.csv"))
    assert [(r["name"], r["note"], r["_drop"]) for r in df.orderBy("name").collect()] == [("A # 1", "n", "waypoints_a.csv"), ("Total", None, "waypoints_a.csv")]
    assert [r["name"] for r in tables.without_totals(df, "name").collect()] == ["A # 1"]
    (tmp_path / "c.csv").write_text("name,n\nA,1 # one\nB,x\n# all\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    assert sorted(tuple(r) for r in tables.inline_commented_csv(spark, str(tmp_path / "c.csv"), schema).collect()) == [("A", 1), ("B", None)]


def test_supersede_and_exclude(spark):
    files = spark.createDataFrame([("/d/a.kmz",), ("/d/a.kml",), ("/d/b.kmz",), ("/d/c.gpx",)], "path string")
    assert sorted(r[0] for r in tables.supersede(files).collect()) == ["/d/a.kml", "/d/b.kmz", "/d/c.gpx"]
    supplied = spark.createDataFrame([("c.gpx, by hand",)], "source string")
    assert sorted(r[0] for r in tables.exclude_supplied(files, supplied).collect()) == ["/d/a.kml", "/d/a.kmz", "/d/b.kmz"]


def test_report_in_order(spark, tmp_path):
    tables.write_report(spark.range(50).select((50 - F.col("id")).alias("ord"), F.concat(F.lit("l"), 50 - F.col("id")).alias("line")), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split() == [f"l{i}" for i in range(1, 51)]


def test_session_stream_splits_as_batch(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:01"), ("z", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "run string, t string").select("run", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = runs.session_stream(runs.drop_stream(spark, str(tmp_path / "in"), "run STRING, ts TIMESTAMP"), "run", least=1)
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM sessions WHERE run = 'a'").collect()) == [1, 2]


def test_upsert_takes_the_latest(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k long, v string, ver int")
    b = spark.createDataFrame([(1, "z", 2), (3, "w", 1)], "k long, v string, ver int")
    assert sorted(tuple(r) for r in runs.upsert(a, b, "k", "ver").collect()) == [(1, "z", 2), (2, "y", 1), (3, "w", 1)]
