"""Geodesy as Column expressions: distances, the UTM projection, walking speed, access classes. (MTH, GEO, FIL-05)

Five distance formulas are kept apart on purpose, as results depend on which one a rule was set with.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii and degree lengths of the distance formulas, thresholds of the classes.
EARTH_M = 6371000.0
EARTH_KM = 6371.0088
DEGREE_M = 110000.0
DEGREE_KM = 110.574
ACCESS_NEAR_M, ACCESS_FAR_M = 2500, 10000
WALK_MAX_KMH, DRIVE_MIN_KMH, FAST_SHARE = 4.5, 11.0, 0.25


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``; null if any input is null. (MTH-01)"""
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance in metres with 110 000 m a degree and the cosine at the first point."""
    return F.hypot((lon2 - lon1) * DEGREE_M * F.cos(F.radians(lat1)), (lat2 - lat1) * DEGREE_M)


def equirect_mid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance in km with 110.574 km a degree and the cosine at the mean latitude."""
    return F.hypot((lon2 - lon1) * DEGREE_KM * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * DEGREE_KM)


def utm(lat: Column, lon: Column, zone: int = 55, south: bool = True, ellipsoid: tuple[float, float] = (6378137.0, 298.257223563)) -> tuple[Column, Column]:
    """Easting and northing on an ellipsoid (half axis, inverse flattening), WGS 84 by default, by the Krueger series to the fourth order in n. (GEO-01)"""
    f = 1 / ellipsoid[1]
    n = f / (2 - f)
    big_a = ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * big_a * east, (10000000 if south else 0) + 0.9996 * big_a * north


def tobler_kmh(slope: Column) -> Column:
    """Walking speed on a slope (rise over run). (MTH-02)"""
    return 6 * F.exp(-3.5 * F.abs(slope + 0.05))


def access_class(off_m: Column) -> Column:
    """Inclusive distance classes; null stays null. (FIL-05)"""
    return F.when(off_m <= ACCESS_NEAR_M, "near").when(off_m <= ACCESS_FAR_M, "long walk").when(off_m.isNotNull(), "beyond")


def speed_class(median: Column, fast: Column) -> Column:
    """Motor, Foot or null (in between). (FIL-03)"""
    return F.when((median >= DRIVE_MIN_KMH) | (fast >= FAST_SHARE), "Motor").when(median <= WALK_MAX_KMH, "Foot")


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Point in polygon by ray casting over the ring's edges; boundary points may fall either way. (GEO-05)"""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def segment_distance(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Planar distance of a point to a segment, by clamped projection. (GEO-06)"""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length)) if length else F.lit(0.0)
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def shoelace(points: Column) -> Column:
    """Area of a ring given as an array of structs (x, y). (GEO-03)"""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2
