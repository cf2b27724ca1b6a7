"""Operators on timestamped runs: steps, speeds, sessions, windows, chunks. (WIN-01..03, AGG-01..04, FIL-23)

A run is a key column; points are ordered by explicit columns, so every window has a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import haversine, speed_class

# Thresholds of a valid and of a moving step.
MAX_GAP_S, MAX_STEP_M, MOVING_KMH, FAST_KMH, MIN_POINTS, SESSION_GAP_S = 120.0, 500.0, 0.7, 12.0, 20, 600.0


def steps(points: DataFrame, run: str, order: Sequence[str], lat: str = "lat", lon: str = "lon", ts: str = "epoch") -> DataFrame:
    """Each point with distance ``m``, seconds ``dt`` and speed ``kmh`` from the point before it in its run; null at the first. (WIN-01)"""
    w = Window.partitionBy(run).orderBy(*order)
    back = points.withColumns({"_lat": F.lag(lat).over(w), "_lon": F.lag(lon).over(w), "_ts": F.lag(ts).over(w)})
    back = back.withColumns({"m": haversine(F.col("_lat"), F.col("_lon"), F.col(lat), F.col(lon)), "dt": F.col(ts) - F.col("_ts")})
    return back.withColumn("kmh", F.try_divide("m", "dt") * 3.6).drop("_lat", "_lon", "_ts")


def valid_step(max_gap: float = MAX_GAP_S, max_step: float | None = MAX_STEP_M) -> Column:
    """Time goes forward by less than the gap, and the distance is below the cap. (FIL-23)"""
    ok = (F.col("dt") > 0) & (F.col("dt") < max_gap)
    return ok & (F.col("m") < max_step) if max_step is not None else ok


def run_speeds(stepped: DataFrame, run: str, valid: Column, moving: float = MOVING_KMH, least: int = MIN_POINTS) -> DataFrame:
    """Median, 90th percentile and fast share of the moving steps of each run, and its speed class. (AGG-01, FIL-03)

    A run needs ``least`` points, valid steps and moving steps. Percentiles are exact with linear interpolation.
    """
    ok = F.coalesce(valid, F.lit(False))
    go = ok & (F.col("kmh") > moving)
    speed = F.when(go, F.col("kmh"))
    out = stepped.groupBy(run).agg(
        F.count("*").alias("points"), F.count_if(ok).alias("valid"), F.count_if(go).alias("moving"),
        F.percentile(speed, 0.5).alias("median_kmh"), F.percentile(speed, 0.9).alias("p90_kmh"), F.avg(F.when(go, (F.col("kmh") > FAST_KMH).cast("double"))).alias("fast"),
    )
    out = out.where((F.col("points") >= least) & (F.col("valid") >= least) & (F.col("moving") >= least))
    return out.withColumn("mode", speed_class(F.col("median_kmh"), F.col("fast")))


def gap_sessions(points: DataFrame, run: str, order: Sequence[str], ts: str = "epoch", gap: float = SESSION_GAP_S, least: int = MIN_POINTS) -> DataFrame:
    """Sessions of each run, split where the gap is more than ``gap`` seconds, with at least ``least`` points. (WIN-03, SRC-11)"""
    w = Window.partitionBy(run).orderBy(*order)
    cut = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("int"), F.lit(0))
    numbered = points.withColumn("_cut", cut).withColumn("session", F.sum("_cut").over(w))
    out = numbered.groupBy(run, "session").agg(F.count("*").alias("n"), F.min(ts).alias("begins"), F.max(ts).alias("ends"))
    return out.where(F.col("n") >= least)


def centred_max(stepped: DataFrame, run: str, valid: Column, half: int = 120, ts: str = "epoch") -> DataFrame:
    """Adds ``near_max``: the greatest valid speed within ``half`` seconds of the step's midpoint. (WIN-02)"""
    mid = stepped.withColumn("mid", F.col(ts) - F.col("dt") / 2)
    w = Window.partitionBy(run).orderBy("mid").rangeBetween(-int(half), int(half))
    return mid.where(F.col("mid").isNotNull()).withColumn("near_max", F.max(F.when(valid, F.col("kmh"))).over(w))


def track_length(stepped: DataFrame, run: str) -> DataFrame:
    """Length in km to two places (half even), vertices and sinuosity's end-to-end part of each run. (GEO-02, GEO-04)"""
    return stepped.groupBy(run).agg(F.bround(F.sum("m") / 1000, 2).alias("km"), F.count("*").alias("vertices"))


#: Ranges of values that are ranked side by side.
RANK_RANGES = 64


def average_ranks(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the average rank of ``by``: ties share the mean of their places. (AGG-18)

    Values are counted first, so a value that is very frequent costs one row. The distinct values are cut at some of their quantiles
    into ranges; each range sums up its own, and the sums of the ranges before it are added.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    cuts = counts.agg(F.percentile_approx(by, [i / RANK_RANGES for i in range(1, RANK_RANGES)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(by))) if cuts else F.lit(0)
    counts = counts.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over at most RANK_RANGES rows
    offsets = counts.groupBy("_part").agg(F.sum("_n").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(by))
    ranked = counts.withColumn("_upto", upto).join(F.broadcast(offsets), "_part")
    return rows.join(ranked.select(by, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), by)


def spearman(rows: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """One row (n, rho) over the pairs with both values; rho is null unless n > ``least``. (AGG-18)"""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(both, x, "_rx"), y, "_ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho")).select("n", F.when(F.col("n") > least, F.col("rho")).alias("rho"))
