"""Areas and networks after noding: dissolve, merged runs, service runs, clipping, ownership of faces. (GEO-14, GEO-15, GEO-19, GEO-20, GEO-22)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.graph import connected_components, materialised


def dissolve(edges: DataFrame, zone: str) -> DataFrame:
    """Outline edges of each zone of one tessellation: an edge that two cells of a zone share is inside it and goes. (GEO-14, AGG-12)

    ``edges(zone, x1, y1, x2, y2)`` holds every cell's edges; parity decides, so nothing is gathered.
    """
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    one = edges.select(zone, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return one.groupBy(zone, "a", "b").agg(F.count("*").alias("n")).where("n % 2 = 1").select(zone, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def merged_runs(edges: DataFrame) -> DataFrame:
    """``(src, dst, weight, run)``: edges joined into maximal runs that no junction interrupts. (GEO-15, WIN-16)

    Two edges belong to one run if they share a node of degree two. A run is named by its least edge number.
    """
    e = materialised(edges.select("src", "dst", "weight").withColumn("edge", F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))))
    ends = e.select("edge", F.col("src").alias("node")).union(e.select("edge", F.col("dst").alias("node")))
    two = ends.groupBy("node").agg(F.count("*").alias("d"), F.min("edge").alias("src"), F.max("edge").alias("dst")).where("d = 2 and src <> dst")
    runs = connected_components(two.select("src", "dst", F.lit(1.0).alias("weight")))
    return e.join(runs, e["edge"] == runs["node"], "left").select("src", "dst", "weight", F.coalesce("component", "edge").alias("run"))


def service_runs(vertices: DataFrame, band: float) -> DataFrame:
    """``(line_id, run, n, first, last)``: unbroken runs of a line's vertices whose network distance is within the band, of two or more. (GEO-19)

    ``vertices(line_id, seq, km)``. A vertex out of reach ends a run, so that no gap is bridged.
    """
    w = Window.partitionBy("line_id").orderBy("seq")
    v = vertices.withColumn("out", F.when(F.col("km") <= band, 0).otherwise(1)).withColumn("run", F.sum("out").over(w)).where("out = 0")
    return v.groupBy("line_id", "run").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).where("n >= 2")


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    """Struct (x1, y1, x2, y2) of the part of a segment inside ``box`` (left, bottom, right, top); null if none is. (GEO-22)"""
    left, bottom, right, top = box
    dx, dy = x2 - x1, y2 - y1
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, x1 - left), (dx, right - x1), (-dy, y1 - bottom), (dy, top - y1)):
        t = F.try_divide(q, p)
        outside = outside | ((p == 0) & (q < 0))
        enter = F.greatest(enter, F.when(p < 0, t).otherwise(0.0))
        leave = F.least(leave, F.when(p > 0, t).otherwise(1.0))
    part = F.struct((x1 + enter * dx).alias("x1"), (y1 + enter * dy).alias("y1"), (x1 + leave * dx).alias("x2"), (y1 + leave * dy).alias("y2"))
    return F.when(~outside & (enter <= leave), part)


def centroids(points: DataFrame, key: str) -> DataFrame:
    """Mean of a key's distinct points, their number and their extent. (GEO-20, GEO-23, AGG-07)"""
    d = points.select(key, "x", "y").distinct()
    return d.groupBy(key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), F.max("x").alias("max_x"), F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.min("y").alias("min_y"))
