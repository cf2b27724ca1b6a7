"""Queries on trajectories, projections and distance formulas, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import datum
from waymark.operators import trajectory as tr
from waymark.plans.base import PTS, STEPS, event_points, hav_sql, read

RUN, ORDER = "user_id", ("ts", "event_id")
#: Gaps between a user's events are hours here, so the thresholds are wider than the operators' defaults.
WIDE = {"max_gap": 86400.0, "max_step": None}


def stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.steps(event_points(spark, sf_dir), RUN, ORDER)


def step_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stepped(spark, sf_dir).where(tr.valid_step(**WIDE))
    return rows.select("event_id", "user_id", F.bround("m", 3).alias("m"), F.bround("dt", 3).alias("dt"), F.bround("kmh", 4).alias("kmh"))


def run_speed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.run_speeds(stepped(spark, sf_dir), RUN, tr.valid_step(**WIDE))
    return out.select("user_id", "points", "moving", F.bround("median_kmh", 4).alias("median_kmh"), F.bround("p90_kmh", 4).alias("p90_kmh"), F.bround("fast", 6).alias("fast"), "mode")


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.gap_sessions(event_points(spark, sf_dir), RUN, ORDER, gap=36000.0, least=3)
    return out.select("user_id", "session", "n", F.bround(F.col("ends") - F.col("begins"), 3).alias("seconds"))


def centred_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.centred_max(stepped(spark, sf_dir), RUN, tr.valid_step(**WIDE), half=43200)
    return out.select("event_id", F.bround("near_max", 4).alias("near_max"), (F.col("near_max") >= 10).alias("driven"))


def chunk_speed_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds by road chunk (here a 0.05 degree cell), chunks with at least 8 steps. (AGG-02)"""
    rows = stepped(spark, sf_dir).where(tr.valid_step(**WIDE))
    out = rows.groupBy(F.floor(F.col("lon") / 0.05).alias("cx"), F.floor(F.col("lat") / 0.05).alias("cy")).agg(
        F.avg("kmh").alias("mean"), F.percentile("kmh", 0.5).alias("median"), F.percentile("kmh", 0.15).alias("p15"),
        F.count("*").alias("n"), F.count_distinct("user_id").alias("runs"), F.sum("m").alias("metres"),
    )
    return out.where("n >= 8").select("cx", "cy", *(F.bround(c, 4).alias(c) for c in ("mean", "median", "p15")), "n", "runs", F.bround("metres", 2).alias("metres"))


def spearman_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.floor("o_totalprice").alias("price"))
    return tr.spearman(rows, "o_custkey", "price").select("n", F.bround("rho", 8).alias("rho"))


def quintile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of discount prices below the first and above the last fifth of quantities. (AGG-19)"""
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    cut = rows.agg(F.percentile("l_quantity", 0.2).alias("q20"), F.percentile("l_quantity", 0.8).alias("q80"))
    both = rows.join(F.broadcast(cut))  # one row
    return both.agg(
        F.max("q20").alias("q20"), F.max("q80").alias("q80"),
        F.bround(F.percentile(F.when(F.col("l_quantity") <= F.col("q20"), F.col("l_extendedprice")), 0.5), 4).alias("low_median"),
        F.bround(F.percentile(F.when(F.col("l_quantity") >= F.col("q80"), F.col("l_extendedprice")), 0.5), 4).alias("high_median"),
    )


def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.utm(F.col("lat"), F.col("lon"))
    return event_points(spark, sf_dir).select("event_id", F.bround(east, 2).alias("easting"), F.bround(north, 2).alias("northing"))


def agd66_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as AGD66 places: their map grid coordinates, and the place on WGS 84 with its shift in metres. (GEO-01)"""
    p = event_points(spark, sf_dir).select("event_id", "lat", "lon")
    east, north = geo.utm(F.col("lat"), F.col("lon"), ellipsoid=datum.ANS)
    old = p.select("event_id", F.col("lat").alias("old_lat"), F.col("lon").alias("old_lon"), F.bround(east, 2).alias("amg_e"), F.bround(north, 2).alias("amg_n"))
    both = old.join(datum.datum_shift(p), "event_id")
    return both.select(
        "event_id", "amg_e", "amg_n", F.bround("lat", 8).alias("lat"), F.bround("lon", 8).alias("lon"),
        F.bround((F.col("lon") - F.col("old_lon")) * 111320 * F.cos(F.radians(F.abs("lat"))), 3).alias("shift_e"), F.bround((F.col("lat") - F.col("old_lat")) * 110570, 3).alias("shift_n"),
    )


def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.track_length(stepped(spark, sf_dir), RUN)


def distance_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's distance to a market by four formulas, and its access class by the first. (MTH-01, FIL-05)"""
    a, o = F.lit(-9.2), F.lit(148.2)
    lat, lon = F.col("lat"), F.col("lon")
    m = geo.haversine(lat, lon, a, o)
    return event_points(spark, sf_dir).select(
        "event_id", F.bround(m, 3).alias("hav_m"), F.bround(geo.haversine(lat, lon, a, o, geo.EARTH_KM), 6).alias("hav_km"),
        F.bround(geo.equirect_m(lat, lon, a, o), 3).alias("flat_m"), F.bround(geo.equirect_mid_km(lat, lon, a, o), 6).alias("flat_km"), geo.access_class(m).alias("access"),
    )


def tobler_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking hours of each run, with ``value`` as elevation. (MTH-02)"""
    rise = F.col("value") - F.lag("value").over(tr.Window.partitionBy(RUN).orderBy(*ORDER))
    rows = stepped(spark, sf_dir).withColumn("rise", rise).where("m > 1")
    hours = F.col("m") / 1000 / F.greatest(geo.tobler_kmh(F.col("rise") / F.col("m")), F.lit(0.05))
    return rows.groupBy("user_id").agg(F.bround(F.sum(hours), 4).alias("hours"), F.count("*").alias("n"))


def gradient_p85(spark: SparkSession, sf_dir: str) -> DataFrame:
    """85th percentile, mean and maximum of the absolute gradient of runs of 300 m or more, and their sinuosity. (AGG-03, AGG-04)"""
    w = tr.Window.partitionBy(RUN).orderBy(*ORDER)
    rows = stepped(spark, sf_dir).withColumn("g", F.when(F.col("m") > 0, F.abs(F.col("value") - F.lag("value").over(w)) / F.col("m") * 100))
    first, last = F.min_by(F.struct("lat", "lon"), F.struct("ts", "event_id")), F.max_by(F.struct("lat", "lon"), F.struct("ts", "event_id"))
    out = rows.groupBy("user_id").agg(F.percentile("g", 0.85).alias("p85"), F.avg("g").alias("mean_g"), F.max("g").alias("max_g"), F.sum("m").alias("len"), first.alias("a"), last.alias("b"))
    end = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return out.where("len >= 300").select("user_id", *(F.bround(c, 5).alias(c) for c in ("p85", "mean_g", "max_g")), F.bround(F.when(end > 1, F.col("len") / end), 5).alias("sinuosity"))


QUERIES = {f.__name__: f for f in (step_deltas, run_speed_stats, gap_sessions, centred_window_max, chunk_speed_agg, spearman_terrain, quintile_split, utm_project, agd66_positions, track_length, distance_formulas, tobler_hours, gradient_p85)}

OK = "(dt > 0 AND dt < 86400)"


def lit(x: float) -> str:
    """A number that DuckDB takes as DOUBLE, not as DECIMAL."""
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def _krueger(half: float = 6378137.0, inverse: float = 298.257223563) -> str:
    """The projection as one SQL text, from the ellipsoid's constants."""
    f = 1 / inverse
    n = f / (2 - f)
    big_a = half / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = 2 * math.sqrt(n) / (1 + n)
    east = "eta" + "".join(f" + {lit(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(al, 1))
    north = "xi" + "".join(f" + {lit(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(al, 1))
    return f"""WITH {PTS}, a AS (SELECT event_id, sinh(atanh(sin(radians(lat))) - {lit(e)} * atanh({lit(e)} * sin(radians(lat)))) AS t, radians(lon - 147) AS lam FROM pts),
b AS (SELECT event_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
SELECT event_id, round_even(500000 + 0.9996e0 * {lit(big_a)} * ({east}), 2) AS easting, round_even(10000000 + 0.9996e0 * {lit(big_a)} * ({north}), 2) AS northing FROM b"""


def _shifted() -> str:
    """The datum shift as SQL, by rotation and scale written out."""
    (a, inv), (a2, inv2) = datum.ANS, datum.WGS84
    e2, f2 = (2 - 1 / inv) / inv, 1 / inv2
    b2, e22 = a2 * (1 - f2), f2 * (2 - f2)
    rx, ry, rz = (f"radians({lit(r)} / 3600)" for r in datum.AGD66_ROTATION)
    dx, dy, dz = (lit(d) for d in datum.AGD66_SHIFT)
    m = f"(1 + {lit(datum.AGD66_SCALE)} / 1e6)"
    return f"""g AS (SELECT event_id, lat, lon, {lit(a)} / sqrt(1 - {lit(e2)} * pow(sin(radians(lat)), 2)) AS n FROM pts), h AS (SELECT event_id, lat, lon, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - {lit(e2)}) * sin(radians(lat)) AS z FROM g),
k AS (SELECT event_id, lat, lon, {dx} + {m} * (x + {rz} * y - {ry} * z) AS x, {dy} + {m} * (y - {rz} * x + {rx} * z) AS y, {dz} + {m} * (z + {ry} * x - {rx} * y) AS z FROM h), q AS (SELECT *, sqrt(x * x + y * y) AS p FROM k), t AS (SELECT *, atan2(z * {lit(a2)}, p * {lit(b2)}) AS t FROM q),
s AS (SELECT event_id, lat AS lat0, lon AS lon0, degrees(atan2(z + {lit(e22 / (1 - e22) * b2)} * pow(sin(t), 3), p - {lit(e22 * a2)} * pow(cos(t), 3))) AS lat, degrees(atan2(y, x)) AS lon FROM t)"""


ORACLES = {
    "agd66_positions": f"""WITH {PTS}, {_shifted()}, u AS ({_krueger(*datum.ANS)})
SELECT s.event_id, easting AS amg_e, northing AS amg_n, round_even(lat, 8) AS lat, round_even(lon, 8) AS lon, round_even((lon - lon0) * 111320 * cos(radians(abs(lat))), 3) AS shift_e, round_even((lat - lat0) * 110570, 3) AS shift_n FROM s JOIN u ON u.event_id = s.event_id""",
    "step_deltas": f"WITH {STEPS} SELECT event_id, user_id, round_even(m, 3) AS m, round_even(dt, 3) AS dt, round_even(kmh, 4) AS kmh FROM st WHERE {OK}",
    "run_speed_stats": f"""WITH {STEPS}, g AS (SELECT user_id, count(*) AS points, count(*) FILTER (WHERE {OK}) AS valid, count(*) FILTER (WHERE {OK} AND kmh > 0.7) AS moving,
quantile_cont(kmh, 0.5) FILTER (WHERE {OK} AND kmh > 0.7) AS med, quantile_cont(kmh, 0.9) FILTER (WHERE {OK} AND kmh > 0.7) AS p90, avg(CAST(kmh > 12 AS DOUBLE)) FILTER (WHERE {OK} AND kmh > 0.7) AS fast FROM st GROUP BY user_id)
SELECT user_id, points, moving, round_even(med, 4) AS median_kmh, round_even(p90, 4) AS p90_kmh, round_even(fast, 6) AS fast, CASE WHEN med >= 11 OR fast >= 0.25 THEN 'Motor' WHEN med <= 4.5 THEN 'Foot' END AS mode
FROM g WHERE points >= 20 AND valid >= 20 AND moving >= 20""",
    "gap_sessions": f"""WITH {PTS}, c AS (SELECT *, CASE WHEN epoch - lag(epoch) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 36000 THEN 1 ELSE 0 END AS cut FROM pts),
s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM c)
SELECT user_id, session, count(*) AS n, round_even(max(epoch) - min(epoch), 3) AS seconds FROM s GROUP BY user_id, session HAVING count(*) >= 3""",
    "centred_window_max": f"""WITH {STEPS}, md AS (SELECT *, epoch - dt / 2 AS mid FROM st WHERE dt IS NOT NULL),
w AS (SELECT event_id, max(CASE WHEN {OK} THEN kmh END) OVER (PARTITION BY user_id ORDER BY mid RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS nm FROM md)
SELECT event_id, round_even(nm, 4) AS near_max, nm >= 10 AS driven FROM w""",
    "chunk_speed_agg": f"""WITH {STEPS} SELECT CAST(floor(lon / 0.05) AS BIGINT) AS cx, CAST(floor(lat / 0.05) AS BIGINT) AS cy, round_even(avg(kmh), 4) AS mean, round_even(quantile_cont(kmh, 0.5), 4) AS median, round_even(quantile_cont(kmh, 0.15), 4) AS p15,
count(*) AS n, count(DISTINCT user_id) AS runs, round_even(sum(m), 2) AS metres FROM st WHERE {OK} GROUP BY 1, 2 HAVING count(*) >= 8""",
    "spearman_terrain": """WITH r AS (SELECT rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS rx, rank() OVER (ORDER BY floor(o_totalprice)) + (count(*) OVER (PARTITION BY floor(o_totalprice)) - 1) / 2.0 AS ry FROM orders)
SELECT count(*) AS n, CASE WHEN count(*) > 10 THEN round_even(corr(rx, ry), 8) END AS rho FROM r""",
    "quintile_split": """WITH c AS (SELECT quantile_cont(l_quantity, 0.2) AS q20, quantile_cont(l_quantity, 0.8) AS q80 FROM lineitem)
SELECT max(q20) AS q20, max(q80) AS q80, round_even(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity <= q20), 4) AS low_median, round_even(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity >= q80), 4) AS high_median FROM lineitem, c""",
    "utm_project": _krueger(),
    "track_length": f"WITH {STEPS} SELECT user_id, round_even(sum(m) / 1000, 2) AS km, count(*) AS vertices FROM st GROUP BY user_id",
    "distance_formulas": f"""WITH {PTS}, d AS (SELECT event_id, {hav_sql("lat", "lon", "-9.2", "148.2")} AS m, {hav_sql("lat", "lon", "-9.2", "148.2", "6371.0088")} AS km,
sqrt(pow((148.2 - lon) * 110000 * cos(radians(lat)), 2) + pow((-9.2 - lat) * 110000, 2)) AS fm, sqrt(pow((148.2 - lon) * 110.574 * cos(radians((lat + -9.2) / 2)), 2) + pow((-9.2 - lat) * 110.574, 2)) AS fk FROM pts)
SELECT event_id, round_even(m, 3) AS hav_m, round_even(km, 6) AS hav_km, round_even(fm, 3) AS flat_m, round_even(fk, 6) AS flat_km, CASE WHEN m <= 2500 THEN 'near' WHEN m <= 10000 THEN 'long walk' ELSE 'beyond' END AS access FROM d""",
    "tobler_hours": f"""WITH {STEPS}, r AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rise FROM st)
SELECT user_id, round_even(sum(m / 1000 / greatest(6 * exp(-3.5 * abs(rise / m + 0.05)), 0.05)), 4) AS hours, count(*) AS n FROM r WHERE m > 1 GROUP BY user_id""",
    "gradient_p85": f"""WITH {STEPS}, r AS (SELECT *, CASE WHEN m > 0 THEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / m * 100 END AS g,
first_value(lat) OVER w AS alat, first_value(lon) OVER w AS alon, last_value(lat) OVER w AS blat, last_value(lon) OVER w AS blon FROM st WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT user_id, quantile_cont(g, 0.85) AS p85, avg(g) AS mean_g, max(g) AS max_g, sum(m) AS len, {hav_sql("any_value(alat)", "any_value(alon)", "any_value(blat)", "any_value(blon)")} AS e FROM r GROUP BY user_id)
SELECT user_id, round_even(p85, 5) AS p85, round_even(mean_g, 5) AS mean_g, round_even(max_g, 5) AS max_g, round_even(CASE WHEN e > 1 THEN len / e END, 5) AS sinuosity FROM a WHERE len >= 300""",
}
