"""Annotated CSV, manifests, schema-sniffed discovery, total-row suppression. (SRC-12..19, SNK-01)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def commented_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """CSV with a header and lines that begin with ``#`` skipped; blank cells are null. (SRC-13)"""
    df = spark.read.csv(path, header=True, schema=schema, comment="#", sep=sep, mode="PERMISSIVE", enforceSchema=False)
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def inline_commented_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stricter rule: ``#`` ends a line wherever it stands. Lines are cut, then parsed; the first line left is the header."""
    lines = spark.read.text(path, wholetext=False).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    header = ",".join(schema.fieldNames())
    rows = lines.where(F.regexp_replace("line", r"\s*,\s*", ",") != header)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = rows.select(F.from_csv("line", text.simpleString()[7:-1].replace(":", " ")).alias("r")).select("r.*")
    return parsed.select(*(F.nullif(F.trim(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``name, size, modified, drive_id``. (SRC-14)"""
    return spark.read.csv(path, header=True, sep="\t", comment="#", schema="name STRING, size BIGINT, modified STRING, drive_id STRING")


def without_totals(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name is blank or begins with ``Total`` are sums, not places. (SRC-16)"""
    return df.where((F.coalesce(F.trim(name), F.lit("")) != "") & ~F.col(name).startswith("Total"))


def drops(spark: SparkSession, pattern: str, need: tuple[str, ...] = ("name", "note")) -> DataFrame:
    """Every CSV file of a folder whose header has the needed columns, as one table of text columns with ``_drop`` provenance. (SRC-15, STM-01)

    Files are told apart by their first line that is not a comment; which columns a file has is its own business, and what it
    lacks is null.
    """
    lines = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", r"\r?\n"), lambda x: (x != "") & ~x.startswith("#"))[0].alias("header"))
    heads = lines.collect()  # one row a file
    out = None
    for r in sorted(heads, key=lambda r: r["path"]):
        cols = [c.strip().strip('"') for c in (r["header"] or "").split(",")]
        if set(need) <= set(cols):
            one = commented_csv(spark, r["path"], ", ".join(f"`{c}` STRING" for c in cols)).withColumn("_drop", F.lit(r["path"].rsplit("/", 1)[-1]))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` STRING" for c in (*need, "_drop")))


def supersede(files: DataFrame) -> DataFrame:
    """Drops a ``.kmz`` if a ``.kml`` of the same stem is there. ``files(path)``. (SRC-18)"""
    stem = F.regexp_replace(F.lower("path"), r"\.(kmz|kml)$", "")
    kml = files.where(F.lower("path").endswith(".kml")).select(stem.alias("stem")).distinct()
    kmz = F.lower("path").endswith(".kmz")
    return files.where(~kmz).union(files.where(kmz).withColumn("_s", stem).join(kml, F.col("_s") == F.col("stem"), "left_anti").drop("_s"))


def exclude_supplied(files: DataFrame, supplied: DataFrame) -> DataFrame:
    """Drops files named as the first source of a supplied geometry. ``supplied(source)``. (SRC-19)"""
    names = supplied.select(F.trim(F.split("source", ",")[0]).alias("n"))
    return files.join(names, F.element_at(F.split("path", "/"), -1) == F.col("n"), "left_anti")


def write_report(lines: DataFrame, path: str) -> None:
    """An ordered ``(ord, line)`` report as text. (SNK-07)

    Lines are sorted across partitions, so the part files read in name order are the report; a report is small, and is written as one file.
    """
    lines.orderBy("ord").coalesce(1).select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty cells. (SNK-01)"""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
