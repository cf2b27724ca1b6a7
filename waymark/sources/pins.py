"""Field layers: typed waypoints, returned pins, the geocode cache, river stems, and file writers. (SRC-17, SRC-26, SRC-27, SRC-29, SNK-02, SNK-06)"""

from __future__ import annotations

import html
import sqlite3
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from waymark.operators.spatial import best_per_key


@pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML character references decoded, in Arrow batches; null stays null."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def stamp_of(name: Column) -> tuple[Column, Column]:
    """A name without its trailing time, and that time as ISO text or null. (DAT-03)"""
    pattern = r"\s*(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}(?::\d{2})?)\s*$"
    day, clock = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    return F.trim(F.regexp_replace(name, pattern, "")), F.when(day != "", F.concat(day, F.lit("T"), clock))


def waypoints(placemarks: DataFrame) -> DataFrame:
    """``(name, recorded, lon, lat, note, accuracy_m, photos)`` of point placemarks ``(name, description, coordinates)``. (SRC-17)"""
    name, recorded = stamp_of(F.coalesce("name", F.lit("")))
    xy = F.split(F.trim("coordinates"), ",")
    note = F.regexp_extract(F.coalesce("description", F.lit("")), r"(?s)desc_user:start\s*-->(.*?)<!--\s*desc_user:end", 1)
    plain = F.trim(F.regexp_replace(unescaped(F.regexp_replace(note, r"(?s)<[^>]*>", " ")), r"\s+", " "))
    accuracy = F.regexp_extract(F.coalesce("description", F.lit("")), r"(?i)accuracy\D{0,20}(\d+(?:\.\d+)?)", 1).try_cast("double")
    out = placemarks.where("coordinates is not null").select(
        name.alias("name"), recorded.alias("recorded"), xy[0].try_cast("double").alias("lon"), xy[1].try_cast("double").alias("lat"), F.nullif(plain, F.lit("")).alias("note"),
        accuracy.alias("accuracy_m"), F.regexp_count(F.coalesce("description", F.lit("")), F.lit("(?i)<img ")).alias("photos"),
    )
    return out.orderBy(F.lower("name"), "recorded")


def pins(docs: DataFrame) -> DataFrame:
    """``(path, ord, folder, name, lon, lat, note)`` of the pins of KML texts ``docs(path, kml)``, with their folder path. (SRC-29)"""

    def walk(el: ET.Element, folder: str) -> Iterator[tuple[str, str, str, str]]:
        for child in el:
            tag = child.tag.rpartition("}")[2]
            text = lambda t, c=child: next((x.text or "" for x in c.iter() if x.tag.rpartition("}")[2] == t), "")
            if tag in ("Folder", "Document"):
                own = next(((x.text or "") for x in child if x.tag.rpartition("}")[2] == "name"), "")
                yield from walk(child, f"{folder}/{own}" if tag == "Folder" else folder)
            elif tag == "Placemark":
                yield folder, text("name"), text("coordinates"), text("description")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kml in zip(b["path"], b["kml"], strict=True):
                for i, (folder, name, at, note) in enumerate(walk(ET.fromstring(kml), "")):
                    xy = at.strip().split(",")
                    if len(xy) >= 2:
                        rows.append((path, i, folder, name.strip(), float(xy[0]), float(xy[1]), note))
            yield pd.DataFrame(rows, columns=["path", "ord", "folder", "name", "lon", "lat", "note"])

    return docs.select("path", "kml").mapInPandas(run, "path string, ord long, folder string, name string, lon double, lat double, note string")


def last_pins(rows: DataFrame) -> DataFrame:
    """Of pins with one name the last of a file wins. (SRC-29, JOI-01)"""
    return best_per_key(rows.withColumn("_k", F.concat_ws("\n", "path", "name")), "_k", F.desc("ord")).drop("_k")


def moved_pins(returned: DataFrame, sent: DataFrame, least_m: float = 50.0) -> DataFrame:
    """``(name, lon, lat, moved_km, what)``: returned pins that are new, or were moved by ``least_m`` or more. (FIL-22)"""
    from waymark.functions.geo import equirect_mid_km

    s = sent.select(F.col("name").alias("sn"), F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    both = returned.join(s, returned["name"] == s["sn"], "left").withColumn("moved_km", equirect_mid_km(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon")))
    what = F.when(F.col("sn").isNull(), "new").when(F.col("moved_km") * 1000 >= least_m, "moved").otherwise("unmoved")
    return both.select("name", "lon", "lat", "moved_km", what.alias("what"))


def geocode_cache(spark: SparkSession, path: str) -> DataFrame:
    """``(source, name, hit, lat, lon)`` of a cache file that maps ``source:name`` to its hits. (SRC-26)"""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,array<struct<name:string,lat:double,lon:double>>>")).alias("k", "hits"))
    return entries.select(F.substring_index("k", ":", 1).alias("source"), F.regexp_replace("k", "^[^:]*:", "").alias("name"), F.explode("hits").alias("h")).select("source", "name", F.col("h.name").alias("hit"), F.col("h.lat").alias("lat"), F.col("h.lon").alias("lon"))


def river_stems(rivers: DataFrame, names: dict[int, str]) -> DataFrame:
    """Reaches of the named main stems, with the name. (SRC-27, MAP-01)"""
    table = rivers.sparkSession.createDataFrame(list(names.items()), "stem long, river string")
    return rivers.join(F.broadcast(table), rivers["MAIN_RIV"] == table["stem"]).drop("stem")  # as many rows as the caller's dict


def write_gpkg(rows: Iterable[tuple[str, list[tuple[float, float]]]], path: str, layer: str) -> None:
    """A GeoPackage layer of lines, written by the driver: a delivered map layer is small. (SNK-02)"""
    con = sqlite3.connect(path)
    con.execute("PRAGMA application_id = 1196444487")
    con.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
    con.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
    quoted = '"' + layer.replace('"', '""') + '"'
    if not con.execute("SELECT 1 FROM gpkg_contents WHERE table_name = ?", (layer,)).fetchone():
        con.execute(f"CREATE TABLE {quoted} (fid INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, 4326)", (layer, layer))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'LINESTRING', 4326, 0, 0)", (layer,))
    for name, pts in rows:
        blob = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BII", 1, 2, len(pts)) + b"".join(struct.pack("<2d", *p) for p in pts)
        con.execute(f"INSERT INTO {quoted} (name, geom) VALUES (?, ?)", (name, blob))
    con.commit()
    con.close()


def to_gpx_waypoints(df: DataFrame, name: str, lon: str, lat: str) -> DataFrame:
    """A GPX waypoint a row. (SNK-06)"""
    from waymark.sources.tracks import escaped

    return df.select(F.concat(F.format_string('<wpt lat="%.6f" lon="%.6f"><name>', lat, lon), escaped(F.col(name)), F.lit("</name></wpt>")).alias("value"))
