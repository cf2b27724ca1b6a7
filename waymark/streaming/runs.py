"""Structured Streaming: discovered drops, gap sessions, first-seen records, upserts. (STM-01, STM-02, STM-04, STM-05)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from waymark.sources.tables import commented_csv


def drop_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream, with their name as ``_drop``. (STM-01)"""
    return spark.readStream.schema(schema).format(fmt).load(folder).withColumn("_drop", F.col("_metadata.file_name"))


def session_stream(points: DataFrame, run: str, ts: str = "ts", gap: str = "600 seconds", late: str = "1 hour", least: int = 20) -> DataFrame:
    """Runs split where the gap is more than ``gap``, closed when the watermark has passed. The same split as the batch operator. (STM-02)"""
    timed = points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    # a session window ends a gap after its last event; an event exactly at that end belongs to it in batch and stream alike
    out = timed.groupBy(F.session_window(ts, gap).alias("w"), run).agg(F.count("*").alias("n"), F.min(ts).alias("begins"), F.max(ts).alias("ends"))
    return out.where(F.col("n") >= least).select(run, "n", "begins", "ends")


def first_seen(points: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark; the best row needs the batch operator. (STM-04)"""
    return points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert(current: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """The current table with a batch of corrections applied: of each key the row of the highest version. For ``foreachBatch``. (STM-05)"""
    both = current.unionByName(batch, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, *(c for c in cols if c != version))).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in cols)).select(*both.columns)


def discover(spark: SparkSession, folder: str, out: str, checkpoint: str, columns: tuple[str, ...], need: tuple[str, ...] = ("name", "note"), pattern: str = "*.csv", most: int = 100) -> StreamingQuery:
    """New files of a folder that have the needed columns, as rows in ``out/rows``: the drop is told by its schema, not by its name. (STM-01, SRC-15)

    A file's header is its first line that is no comment. A file with all of ``need`` joins with those of ``columns`` that it has, the others null, and its
    name as ``_drop``; any other is passed over. Each file seen is listed in ``out/files``; Spark passes over files without a byte. A trigger takes at most ``most`` files, and writes
    its own folder, so one that is repeated after a failure replaces what it wrote; the checkpoint knows the files seen, also after a restart.
    """
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    names = seen.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most).load(folder).select("path")  # no content is read

    def take(batch: DataFrame, number: int) -> None:
        rows, files = None, []
        for path in sorted(r["path"] for r in batch.collect()):  # at most ``most`` names
            line = batch.sparkSession.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").first()
            header = [c.strip().strip('"') for c in line["value"].split(",")] if line else []
            joins = set(need) <= set(header)
            files.append((path, joins, header))
            if joins:
                one = commented_csv(batch.sparkSession, path, ", ".join(f"`{c}` STRING" for c in header))
                one = one.select(*(F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns), F.lit(path.rsplit("/", 1)[-1]).alias("_drop"))
                rows = one if rows is None else rows.unionByName(one)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        batch.sparkSession.createDataFrame(files, "path string, joins boolean, columns array<string>").write.mode("overwrite").parquet(f"{out}/files/batch={number}")

    return names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
