"""Means that are rounded from their exact value."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.plans.base import exact_mean


def test_a_mean_on_a_tie_does_not_depend_on_the_order(spark):
    # the exact mean is 2.565; a sum of doubles in ascending order gives 2.5650000000000004
    values = [0.72, 1.64, 1.72, 1.9, 2.62, 2.98, 3.53, 5.41]
    for order in ("v", "-v"):
        rows = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).orderBy(F.expr(order)).coalesce(1)
        assert rows.agg(exact_mean("v", 2).alias("m")).first()["m"] == 2.56


def test_means_of_what_no_decimal_holds(spark):
    mean = lambda *v: spark.createDataFrame([(x,) for x in v], "v double").agg(exact_mean("v", 2).alias("m")).first()["m"]
    assert mean(1.0, None, 2.0) == 1.5 and mean(None) is None and math.isinf(mean(float("inf"), 1.0)) and mean(1e30, 1e30) == 1e30
