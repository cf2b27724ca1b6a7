"""The centred window as a stream: a step's answer waits until the watermark has passed its window's end. (STM-03)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centred_max_stream(steps: DataFrame, run: str, half: float = 120.0, late: str = "10 minutes", ts: str = "mid_ts") -> DataFrame:
    """``(run, at, near_max)``: for each step the greatest speed within ``half`` seconds of its midpoint, in append mode.

    ``steps(run, mid_ts, kmh, step_id)``. Each step is sent to the windows of the steps around it by a stream-stream interval join of
    the steps with themselves; the watermark bounds the state to the interval.
    """
    own = steps.select(F.col(run).alias("_run"), F.col(ts).alias("at"), F.col("step_id").alias("_id")).withWatermark("at", late)
    near = steps.select(F.col(run).alias("_other"), F.col(ts).alias("other_at"), F.col("kmh").alias("_kmh")).withWatermark("other_at", late)
    gap = f"INTERVAL {int(half)} SECONDS"
    pairs = own.join(near, F.expr(f"_run = _other AND other_at >= at - {gap} AND other_at <= at + {gap}"))
    # the join's rows keep the time of the step, so a window of no width closes when the watermark has passed it
    return pairs.groupBy(F.window("at", "1 second"), "_run", "_id").agg(F.max("_kmh").alias("near_max")).select(F.col("_run").alias(run), F.col("_id").alias("step_id"), "near_max")
