"""Derived inputs that Spark and DuckDB compute alike, and SQL snippets for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(name: str, digits: int) -> Column:
    """The mean of a double column of at most 12 decimals, rounded half even from its exact value, so that the order of the rows does not matter. (AGG-14)

    With a value that no decimal holds it is the mean of the doubles.
    """
    exact = F.expr(f"try_cast({name} AS DECIMAL(30, 12))")
    mean = F.sum(exact) / F.count(name).cast("decimal(20,0)")
    return F.when(F.count(exact) == F.count(name), F.bround(mean, digits).cast("double")).otherwise(F.bround(F.avg(name), digits))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as GPS points: a run is a user's events in time order; positions follow from the event id."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "ts", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"),
        (148 + (F.col("event_id") * 7919 % 10000) / 2e4).alias("lon"), (-9.5 + (F.col("event_id") * 104729 % 10000) / 2e4).alias("lat"),
    )


PTS = "pts AS (SELECT event_id, user_id, ts, event_type, value, epoch_us(ts) / 1e6 AS epoch, 148 + ((event_id * 7919) % 10000) / 2e4 AS lon, -9.5 + ((event_id * 104729) % 10000) / 2e4 AS lat FROM events)"


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6371000.0") -> str:
    return f"2 * {radius} * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


STEPS = f"""{PTS}, lagged AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(epoch) OVER w AS pts FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
st0 AS (SELECT *, {hav_sql("plat", "plon", "lat", "lon")} AS m, epoch - pts AS dt FROM lagged),
st AS (SELECT *, CASE WHEN dt <> 0 THEN m / dt * 3.6 END AS kmh FROM st0)"""


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as places in metres on a 20 km square."""
    s = read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", "s_name", "s_nationkey", (F.col("s_suppkey") * 7919 % 20011).cast("double").alias("x"), (F.col("s_suppkey") * 104729 % 20011).cast("double").alias("y"))


SUP = "sup AS (SELECT s_suppkey, s_name, s_nationkey, CAST((s_suppkey * 7919) % 20011 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 20011 AS DOUBLE) AS y FROM supplier)"


def event_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as points in metres on the same square."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", (F.col("event_id") * 6007 % 20011).cast("double").alias("x"), (F.col("event_id") * 15013 % 20011).cast("double").alias("y"))


EVM = "evm AS (SELECT event_id, user_id, event_type, CAST((event_id * 6007) % 20011 AS DOUBLE) AS x, CAST((event_id * 15013) % 20011 AS DOUBLE) AS y FROM events)"
