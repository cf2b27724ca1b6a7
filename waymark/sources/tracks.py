"""Recordings and layers: GPX, KML, KMZ, GeoPackage, WKB, GeoJSON. (SRC-01..12, SRC-17, SNK-03..05)

XML goes through Spark's XML source. Zipped and SQLite containers are read as binary files in Arrow batches, in memory: a file
is one row, so files spread over the cluster and no executor writes anything.
"""

from __future__ import annotations

import io
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "array<array<struct<x:double,y:double>>>"

GPX_SCHEMA = "name STRING, desc STRING, trkseg ARRAY<STRUCT<trkpt: ARRAY<STRUCT<_lat: DOUBLE, _lon: DOUBLE, ele: DOUBLE, time: STRING>>>>"


def gpx_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row a track, with its file. (SRC-01)"""
    return spark.read.format("xml").option("rowTag", "trk").schema(GPX_SCHEMA).load(path).withColumn("source_file", F.col("_metadata.file_name"))


def gpx_points(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Timed points of each segment with at least ``least`` of them; a point without a valid time is skipped. (SRC-02, DAT-01)"""
    t = gpx_tracks(spark, path)
    seg = t.select("source_file", "name", F.posexplode("trkseg").alias("seg", "s"))
    pts = seg.select("source_file", "name", "seg", F.posexplode("s.trkpt").alias("seq", "p"))
    epoch = F.unix_micros(F.try_to_timestamp("p.time")) / 1e6
    pts = pts.select("source_file", "name", "seg", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"), epoch.alias("epoch")).where("epoch is not null")
    return pts.withColumn("_n", F.count("*").over(Window.partitionBy("source_file", "name", "seg"))).where(F.col("_n") >= least).drop("_n")


def gpx_dates(spark: SparkSession, path: str) -> DataFrame:
    """First and last time of each file. (SRC-03, DAT-02)"""
    p = gpx_points(spark, path, 1)
    stamp = lambda c: F.timestamp_micros((c * 1e6).cast("long"))
    return p.groupBy("source_file").agg(stamp(F.min("epoch")).alias("start_time"), stamp(F.max("epoch")).alias("end_time"))


def coordinates(text: Column) -> Column:
    """Points of a KML coordinate text; bad tokens are skipped. (SRC-05)"""
    token = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t.rlike(r"^-?[0-9.]+,-?[0-9.]+"))
    return F.filter(F.transform(token, lambda t: F.struct(F.split(t, ",")[0].try_cast("double").alias("x"), F.split(t, ",")[1].try_cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def kml_lines(docs: DataFrame) -> DataFrame:
    """``(path, part, points)``: the lines of KML texts ``docs(path, kml)`` with at least two points; stubs are dropped. (SRC-04, SRC-05)"""
    lines = F.regexp_extract_all("kml", F.lit(r"(?s)<LineString>.*?<coordinates>(.*?)</coordinates>"), F.lit(1))
    return docs.select("path", F.posexplode(lines).alias("part", "c")).select("path", "part", coordinates(F.col("c")).alias("points")).where(F.size("points") >= 2)


def gx_tracks(docs: DataFrame) -> DataFrame:
    """``(path, run, seq, lat, lon, epoch)`` of gx:Track; when and coord are paired up to the shorter. (SRC-06)"""
    tracks = docs.select("path", F.posexplode(F.regexp_extract_all("kml", F.lit(r"(?s)<gx:Track>(.*?)</gx:Track>"), F.lit(1))).alias("run", "t"))
    when, coord = F.regexp_extract_all("t", F.lit("<when>(.*?)</when>"), F.lit(1)), F.regexp_extract_all("t", F.lit("<gx:coord>(.*?)</gx:coord>"), F.lit(1))
    rows = tracks.select("path", "run", when.alias("w"), coord.alias("c")).withColumn("n", F.least(F.size("w"), F.size("c")))
    rows = rows.select("path", "run", F.posexplode(F.arrays_zip(F.slice("w", F.lit(1), F.col("n")), F.slice("c", F.lit(1), F.col("n")))).alias("seq", "z"))
    xy = F.split(F.trim(F.col("z.1")), r"\s+")
    return rows.select("path", "run", "seq", xy[1].try_cast("double").alias("lat"), xy[0].try_cast("double").alias("lon"), (F.unix_micros(F.try_to_timestamp(F.col("z.0"))) / 1e6).alias("epoch")).where("epoch is not null")


def kml_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, kml)`` of KML files and of KMZ archives: ``doc.kml`` if there, else the first KML member. (SRC-07)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                if p.lower().endswith(".kmz"):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        kml = [n for n in z.namelist() if n.lower().endswith(".kml")]
                        raw = z.read("doc.kml" if "doc.kml" in kml else kml[0]) if kml else b""
                texts.append(bytes(raw).decode("utf-8", "replace"))
            yield pd.DataFrame({"path": b["path"], "kml": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, kml string")


def wkb_parts(data: bytes) -> list[list[tuple[float, float]]] | None:
    """Parts of a WKB (Multi)LineString, byte order read for each part; Z and M are dropped; None for other kinds. (SRC-09, BIN-01)"""
    at = 0

    def take(fmt: str):  # noqa: ANN202
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def one() -> list[list[tuple[float, float]]] | None:
        nonlocal at
        order = "<" if take("B")[0] else ">"
        (kind,) = take(order + "I")
        z, m, srid = kind & 0x80000000, kind & 0x40000000, kind & 0x20000000
        kind &= 0x0FFFFFFF
        iso, kind = divmod(kind, 1000)
        dims = 2 + (bool(z) or iso in (1, 3)) + (bool(m) or iso in (2, 3))
        if srid:
            at += 4
        (n,) = take(order + "I")
        if kind == 2:
            return [[take(f"{order}{dims}d")[:2] for _ in range(n)]]
        if kind == 5:
            parts = [one() for _ in range(n)]
            return [p for q in parts if q for p in q]
        return None

    return one()


def gpkg_blob(data: bytes) -> list[list[tuple[float, float]]] | None:
    """A GeoPackage geometry blob: its header's length follows from the envelope flag. (SRC-10)"""
    if data[:2] != b"GP":
        return wkb_parts(data)
    return wkb_parts(data[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(data[3] >> 1) & 7] :])


def gpkg_lines(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """``(path, fid, parts)`` of a layer; a blob of another kind is skipped, a file without the layer gives no row. (SRC-08)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(raw))
                known = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                if known:
                    quote = lambda x: '"' + x.replace('"', '""') + '"'
                    for fid, blob in con.execute(f"SELECT rowid, {quote(known[0])} FROM {quote(layer)}"):
                        parts = gpkg_blob(blob) if blob else None
                        if parts:
                            rows.append((p, fid, [[{"x": x, "y": y} for x, y in q] for q in parts]))
                con.close()
            yield pd.DataFrame(rows, columns=["path", "fid", "parts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, fid long, parts {POINT}")


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files with the given properties, geometry kind and raw coordinates. (SRC-12, JSN-01)"""
    schema = f"features ARRAY<STRUCT<properties: STRUCT<{properties}>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    df = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return df.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def to_geojson(df: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """One line a feature, for points. (SNK-03)"""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def escaped(c: Column) -> Column:
    """XML escapes. (STR-16)"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_placemarks(df: DataFrame, name: str, x: str, y: str, fields: list[str]) -> DataFrame:
    """A KML placemark a row, with its filled fields as extended data. (SNK-04, SNK-05)"""
    data = F.concat_ws("", *(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f'<Data name="{f}"><value>'), escaped(F.col(f).cast("string")), F.lit("</value></Data>"))) for f in fields))
    return df.select(F.concat(F.lit("<Placemark><name>"), escaped(F.col(name)), F.lit("</name><ExtendedData>"), data, F.lit("</ExtendedData><Point><coordinates>"), F.format_string("%.6f,%.6f", x, y), F.lit("</coordinates></Point></Placemark>")).alias("value"))
