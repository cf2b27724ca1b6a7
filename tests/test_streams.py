from __future__ import annotations

from pyspark.sql import functions as F

from waymark.streaming import runs
from waymark.streaming.centred import centred_max_stream


def test_centred_max_waits_for_its_window(spark, tmp_path):
    rows = [("a", 0, 5.0, 1), ("a", 100, 9.0, 2), ("a", 119, 7.0, 3), ("a", 240, 1.0, 4), ("b", 10, 50.0, 5), ("z", 100_000, 1.0, 9)]
    df = spark.createDataFrame(rows, "run string, s long, kmh double, step_id long").withColumn("mid_ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = centred_max_stream(stream, "run").writeStream.outputMode("append").format("memory").queryName("centred").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["step_id"]: r["near_max"] for r in spark.sql("SELECT * FROM centred").collect()}
    assert got == {1: 9.0, 2: 9.0, 3: 9.0, 4: 1.0, 5: 50.0}


def test_first_seen_keeps_one_of_each(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (1, 5), (2, 6)], "k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = runs.first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["k"])
    q = stream.writeStream.outputMode("append").format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["k"] for r in spark.sql("SELECT k FROM firsts").collect()) == [1, 2]
