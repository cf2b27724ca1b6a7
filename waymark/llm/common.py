"""Shared helpers: scratch tables in the cluster's shared folder, size-checked broadcasts, column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Bytes up to which a side may be broadcast. Beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

#: White space of the word pattern ``[^\x20\x09-\x0D]+``, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder for scratch tables: ``spark.checkpoint.dir``; a local one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Scratch tables of one run. Each is deleted as soon as it is done with; at the end, and on failure, all that are not kept.

    A table that a returned frame still reads is kept (``keep``): the frame is lazy, so its caller reads it later.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[df for df, _ in self.paths.values()])

    def store(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and read it back; this cuts lineage, so a lost executor costs only a reread."""
        path = f"{scratch_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
        except Exception:
            remove(self.spark, path)
            raise
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # the frame is held, so its id stays its own
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.pop(id(df), None)
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                remove(self.spark, path)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs only the reread of its files, not the work before them.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(kind: DataType) -> int:
    """Bytes of a value as a join's hash table holds it; of what has no fixed width, a usual one."""
    if isinstance(kind, StructType):
        return 16 + sum(width(f.dataType) for f in kind)
    return {"string": 48, "binary": 64}.get(kind.typeName(), 16 + 16 * width(kind.elementType) if isinstance(kind, ArrayType) else 8)


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast if ``df`` (a stored table of fixed-width columns) has at most BROADCAST_BYTES; else leave a shuffle join, which AQE may split."""
    rows = BROADCAST_BYTES // width(df.schema)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def draw(*cols: Column | str, seed: int) -> Column:
    """A hash of ``cols`` as a number of 62 bits, to be held against :func:`draw_bound`."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 2)


def draw_bound(wanted: float, rows: int) -> int:
    """The bound below which a draw lies for ``wanted`` of ``rows`` on average; at least one in 2**62, so that it is never 0 for any table."""
    return max(1, min(1 << 62, (int(wanted * 1024) << 62) // (1024 * max(rows, 1))))


def crc_of_id(col: Column) -> Column:
    """Unsigned crc32 of the id as text."""
    return F.crc32(F.encode(col.cast("string"), "utf-8"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
