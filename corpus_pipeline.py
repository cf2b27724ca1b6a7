"""A training-corpus pipeline over ``documents``; each stage is written as Parquet and reread as the next one's input.

1. ``language_id``: documents without a recognised language go (no letter, or a score below MIN_SCORE).
2. ``near_duplicates``: of each group of near copies (5-word shingles, Jaccard 0.8) one document stays, that with the least id.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``mixing``: sources are brought to their target weights; a document is repeated as often as the mix takes it.
5. ``sharding``: each row gets its shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, remove, scratch_root, small, table
from waymark.llm.decontamination import decontaminate
from waymark.llm.language_id import fit, held_out, identify
from waymark.llm.mixing import mixed
from waymark.llm.ngram_jaccard_join import mark_of, row_components
from waymark.llm.sharding import with_shards

#: Least score of a recognised language; clean prose scores near 1.
MIN_SCORE = 0.3
#: Words of a shingle, and least similarity of near copies in hundredths. Operator 3's query has its own, 4 and 85.
SHINGLE_WORDS, SIMILARITY = 5, 80

#: Bytes of a batch of whole texts on its way to a Python worker and back; Spark's default of 64 MB is held several times by each task.
BATCH_BYTES = 4 << 20


def light_batches(spark: SparkSession) -> None:
    """Small Arrow batches in the session: results do not depend on them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    light_batches(spark)
    model = fit(docs, ~held_out(docs))
    out = identify(docs, model)
    pred, score = out.columns[-2:]
    return out.where((F.col(pred) != "und") & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null id stay. Of a group's rows that repeat the kept id, that with the least text hash stays; other groups' rows of that id are not touched."""
    light_batches(spark)
    groups = row_components(docs, SHINGLE_WORDS, SIMILARITY, 100)
    mark = mark_of(docs["text"])
    with Scratch(spark) as scratch:
        gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark")).distinct()
        gone = small(scratch.keep(scratch.store(gone, "gone")))
        kept = docs.join(gone, (docs["doc_id"] == gone["gone"]) & (mark == gone["gone_mark"]), "left_anti")
        least = groups.where("doc_id = component_id")
        ids = least.groupBy(F.col("doc_id").alias("twice")).agg(F.count("*").alias("rows")).where("rows > 1")
        ids = scratch.store(ids.select("twice"), "ids")
        if ids.isEmpty():
            return kept
        # the groups that each text of a repeated id is in; an empty text's is 0
        twice = least.join(small(ids), F.col("doc_id") == F.col("twice")).select("twice", F.col("mark").alias("twice_mark"), F.coalesce("label", F.lit(0)).alias("twice_label")).distinct()
        twice = small(scratch.keep(scratch.store(twice, "twice")))
    same = (kept["doc_id"] == twice["twice"]) & (mark == twice["twice_mark"])
    again = kept.join(twice, same).select(F.col("twice"), F.col("twice_label"), F.struct(*(kept[c] for c in docs.columns)).alias("_row"), mark.alias("_mark"))
    once = kept.join(twice, same, "left_anti")
    # one of the rows of an id and group, by an aggregate that combines before the shuffle
    one = again.groupBy("twice", "twice_label").agg(F.min_by("_row", "_mark").alias("_row"))
    return once.union(one.select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    light_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Hash-based choices and a learned model are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables of the others are deleted once the next stage is written, and all on failure."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        except Exception:
            remove(spark, path)
            raise
        finally:
            if last:
                remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
