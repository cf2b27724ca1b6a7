"""The datum shift: published shifts, and there and back."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import datum


def test_there_and_back_and_nulls(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-12, 0), rng.uniform(140, 156), rng.uniform(0, 4000)) for i in range(200)] + [(900, None, 148.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, h double")
    back = {r["id"]: r for r in datum.datum_shift(datum.datum_shift(df, height="h"), forward=False, height="h").collect()}
    flat = {r["id"]: r for r in datum.datum_shift(datum.datum_shift(df), forward=False).collect()}
    for i, lat, lon, h in rows[:-1]:
        assert math.hypot((back[i]["lat"] - lat) * 110_574, (back[i]["lon"] - lon) * 111_320, back[i]["h"] - h) < 1e-4
        assert math.hypot((flat[i]["lat"] - lat) * 110_574, (flat[i]["lon"] - lon) * 111_320) < 3e-3
    assert back[900]["lat"] is None


def test_the_shift_at_a_sheets_centre(spark):
    """A 1:100,000 sheet at 148.25 E, 9.25 S moves 112.8 m east and 164.6 m north."""
    df = spark.createDataFrame([(1, -9.25, 148.25)], "id long, lat double, lon double")
    r = datum.datum_shift(df).first()
    east, north = (r["lon"] - 148.25) * 111_320 * math.cos(math.radians(abs(r["lat"]))), (r["lat"] + 9.25) * 110_570
    assert abs(east - 112.8) < 0.2 and abs(north - 164.6) < 0.2


def test_grids_of_the_ellipsoids_differ_by_their_size(spark):
    df = spark.createDataFrame([(-9.25, 147.0)], "lat double, lon double")
    (e1, n1), (e2, n2) = (df.select(*(c.alias(k) for k, c in zip("en", geo.utm(F.col("lat"), F.col("lon"), **how), strict=True))).first() for how in ({}, {"ellipsoid": datum.ANS}))
    assert e1 == e2 == 500_000 and 3 < n1 - n2 < 4.5
