"""The datum shift between AGD66 and WGS 84 through geocentric coordinates, and grid coordinates on either ellipsoid. (GEO-01)"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half axis and inverse flattening of the Australian National Spheroid and of WGS 84.
ANS, WGS84 = (6378160.0, 298.25), (6378137.0, 298.257223563)
# The published national parameters from AGD66, as (metres, arc seconds, parts per million); rotations are of the coordinate frame.
AGD66_SHIFT, AGD66_ROTATION, AGD66_SCALE = (-117.808, -51.536, 137.784), (-0.303, -0.446, -0.234), -0.290


def geocentric(lat: Column, lon: Column, height: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column, Column]:
    """x, y and z of a place on an ellipsoid."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    e2, p, q = f * (2 - f), F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - e2) + height) * F.sin(p)


def rotation(forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and the offset of the shift, or of its exact inverse."""
    rx, ry, rz = (math.radians(r / 3600) for r in AGD66_ROTATION)
    matrix = (1 + AGD66_SCALE * 1e-6) * np.array([[1, rz, -ry], [-rz, 1, rx], [ry, -rx, 1]])
    if forward:
        return matrix, np.array(AGD66_SHIFT)
    back = np.linalg.inv(matrix)
    return back, -back @ np.array(AGD66_SHIFT)


def datum_shift(points: DataFrame, forward: bool = True, lat: str = "lat", lon: str = "lon", height: str | None = None) -> DataFrame:
    """``points`` with the columns ``lat`` and ``lon`` moved from AGD66 to WGS 84, or back.

    With a column ``height`` (metres over the ellipsoid) it is moved too, and there and back agree within a tenth of a millimetre; without,
    heights are taken as zero both ways, which costs up to three millimetres. A place that is null stays null. The latitude comes from Bowring's
    formula, exact at the ground to far below a micrometre.
    """
    source, target = (ANS, WGS84) if forward else (WGS84, ANS)
    matrix, offset = rotation(forward)
    a, f = target[0], 1 / target[1]
    b, e2 = a * (1 - f), f * (2 - f)
    own = points.select(*points.columns, F.struct(*(c.alias(n) for n, c in zip("xyz", geocentric(F.col(lat), F.col(lon), F.col(height) if height else F.lit(0.0), source), strict=True))).alias("_g"))
    moved = [F.lit(float(d)) + F.lit(float(r[0])) * F.col("_g.x") + F.lit(float(r[1])) * F.col("_g.y") + F.lit(float(r[2])) * F.col("_g.z") for r, d in zip(matrix, offset, strict=True)]
    own = own.select(*points.columns, F.struct(*(c.alias(n) for n, c in zip("xyz", moved, strict=True))).alias("_m"))
    p = F.hypot(F.col("_m.x"), F.col("_m.y"))
    own = own.select(*points.columns, "_m", p.alias("_p"), F.atan2(F.col("_m.z") * a, p * b).alias("_t"))
    up = F.col("_m.z") + e2 / (1 - e2) * b * F.pow(F.sin("_t"), F.lit(3.0))
    own = own.select(*points.columns, "_m", "_p", F.atan2(up, F.col("_p") - e2 * a * F.pow(F.cos("_t"), F.lit(3.0))).alias("_lat"))
    new = {lat: F.degrees("_lat"), lon: F.degrees(F.atan2(F.col("_m.y"), F.col("_m.x")))}
    if height:
        new[height] = F.col("_p") / F.cos("_lat") - a / F.sqrt(1 - e2 * F.sin("_lat") * F.sin("_lat"))
    return own.select(*(new[c].alias(c) if c in new else F.col(c) for c in points.columns))
