"""The mode of a track by ranked evidence. (FIL-04, GEO-09, STR-20)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.lines import densify, near_lines

# The samples of a track and how near a line must be, the shares that count, and the steepest road in per cent.
SAMPLES, NEAR_M, OVERLAP_SHARE, SURVEY_SHARE, STEEPEST_ROAD = 40, 150.0, 0.95, 0.70, 18.0


def near_share(samples: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """``(line_id, name)``: the share of a line's samples near other lines."""
    return near_lines(samples, others, NEAR_M).groupBy("line_id").agg((F.count("*") / SAMPLES).alias(name))


def per_cent(share: Column) -> Column:
    return F.bround(share * 100, 0).cast("long")


def mode_cascade(points: DataFrame, speeds: DataFrame, gradients: DataFrame, survey: DataFrame) -> DataFrame:
    """``(line_id, mode, rung, why)`` of each of ``points(line_id, seq, x, y)`` by the first evidence that decides.

    1. ``speeds(line_id, mode, median_kmh, fast)`` with a mode. 2. Nearly all of the track runs along one that its speed proved a road. 3. Most of it follows a road of the older
    ``survey(line_id, seq, x, y, motor)``, more than follows a foot track, and ``gradients(line_id, p85)`` is not above what a road does. 4. It is too steep for a road.
    5. What the survey has there is no road. 6. Without a survey: on foot. Tracks of one point, or of no length, have no samples: shares of zero.
    """
    tracks = points.select("line_id").distinct()
    decided = speeds.where("mode is not null").select("line_id", F.when(F.col("mode") == "Motor", "Motor road").otherwise("Foot track").alias("by_speed"), "median_kmh", "fast")
    rest = points.join(decided.select("line_id"), "line_id", "left_anti")
    samples = densify(rest, SAMPLES)
    proven = points.join(decided.where("by_speed = 'Motor road'").select("line_id"), "line_id", "left_semi")
    shares = tracks.join(near_share(samples, proven, "overlap"), "line_id", "left")
    for name, own in (("motor", survey.where("motor")), ("foot", survey.where("not motor"))):
        shares = shares.join(near_share(samples, own.select("line_id", "seq", "x", "y"), name), "line_id", "left")
    rows = shares.join(decided, "line_id", "left").join(gradients.select("line_id", "p85"), "line_id", "left").crossJoin(F.broadcast(survey.limit(1).agg((F.count("*") > 0).alias("surveyed"))))  # one row
    overlap, motor, foot = (F.coalesce(c, F.lit(0.0)) for c in ("overlap", "motor", "foot"))
    steep = F.coalesce(F.col("p85") > STEEPEST_ROAD, F.lit(False))
    rung = (
        F.when(F.col("by_speed").isNotNull(), 1).when(overlap >= OVERLAP_SHARE, 2).when(~F.col("surveyed"), 6)
        .when((motor >= SURVEY_SHARE) & (motor > foot) & ~steep, 3).when(steep, 4).otherwise(5)
    )
    out = rows.select("line_id", "by_speed", "median_kmh", "fast", "p85", overlap.alias("overlap"), motor.alias("motor"), foot.alias("foot"), rung.alias("rung"))
    r = F.col("rung")
    mode = F.when(r == 1, F.col("by_speed")).when(r.isin(2, 3), "Motor road").otherwise("Foot track")
    why = (
        F.when(r == 1, F.format_string("speed: median %.1f km/h, %d%% fast", F.bround("median_kmh", 1), per_cent(F.col("fast"))))
        .when(r == 2, F.format_string("overlap: %d%% along a proven road", per_cent(F.col("overlap"))))
        .when(r == 3, F.format_string("survey: %d%% follows a road", per_cent(F.col("motor"))))
        .when(r == 4, F.format_string("gradient: %d%% is above every road", F.bround("p85", 0).cast("long")))
        .when(r == 5, F.format_string("survey: %d%% follows a road, %d%% a foot track", per_cent(F.col("motor")), per_cent(F.col("foot"))))
        .otherwise("default")
    )
    return out.select("line_id", mode.alias("mode"), "rung", why.alias("why"))
