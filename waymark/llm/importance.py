"""Operator 11: target-distribution importance resampling with an integer word dictionary.

A document's features are its runs of one to three words, in buckets by the crc32 of their bytes. A bucket's gain is the log ratio
of its smoothed shares in the target and in the corpus; a document's weight is the sum over its features. The weight plus
Gumbel noise from a hash of the id orders the documents, and the highest are drawn: a sample without replacement in proportion to the
exponential of the weight.

Dictionary. Texts are worked on in slices. The slice's distinct words get integer ids; a run is a tuple of ids, packed as the id of
the run before and that of its last word. Each distinct tuple is hashed once: the register of the shorter tuple runs on over a
space and the bytes of the last word. The buckets then go back to all occurrences by the tuples' numbers: once as counts, once as
gains. No word or run is shuffled; a task sends one count for each bucket it met. Texts are read twice, so nothing of their size is
stored.

Bounds. The driver holds one count and one gain for each bucket and one row for each partition of the ranks.

Cases. A null text has no words, no features and weight 0. A null id draws its noise as the text ``null`` and comes last among ties. Rows
are kept as they are, repeated ones too; which of two equal rows has which rank is open. Without target texts, or without documents,
every count of that side is 0. Other columns are never looked at. A word is known by a 64-bit hash within its slice.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import kernel as K
from waymark.llm.common import Scratch

#: Bytes of text in a slice; a longer text makes one of its own.
SLICE_BYTES = 1 << 21
#: Words up to this many bytes are hashed side by side, longer ones each alone.
SHORT = 64

#: A byte as the words take it: A-Z lowered, what is outside of words as a space.
INSIDE = np.full(256, 0x20, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    INSIDE[_b] = _b
INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B]

#: The register's change by a byte, of the polynomial that zlib takes.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


class Dictionary:
    """The distinct words of a slice: ``word`` (bytes) and ``crc`` of each id, and the ids in order of the text."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        found = K.Words(data, at)
        _, first, self.ids = np.unique(found.hash, return_index=True, return_inverse=True)
        self.row, self.size = found.row, len(first)
        self.start, self.length = found.start[first], found.end[first] - found.start[first]
        self.data = data
        self.crc = np.array([zlib.crc32(self.word(i)) for i in range(self.size)], np.uint32)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def extend(self, crc: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The crc32 of the bytes behind ``crc``, a space and the word ``last``, for each tuple."""
        length = self.length[last]
        order = np.argsort(np.minimum(length, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
        last, length = last[order], length[order]
        far = int(np.searchsorted(-length, -SHORT))  # so many are longer than SHORT
        reg = ~crc[order]
        reg = CRC[(reg ^ 0x20) & 0xFF] ^ (reg >> np.uint32(8))
        start = self.start[last]
        for j in range(int(length[far]) if far < len(length) else 0):
            n = int(np.searchsorted(-length, -j))  # those that have a byte j
            own = reg[far:n]
            reg[far:n] = CRC[(own ^ self.data[start[far:n] + j]) & 0xFF] ^ (own >> np.uint32(8))
        for i in range(far):
            reg[i] = ~np.uint32(zlib.crc32(self.word(last[i]), int(~reg[i])))
        out = np.empty_like(reg)
        out[order] = ~reg
        return out


def runs(data: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words of each row, and for each length of run (crc32 of the distinct tuples, tuple of each occurrence, its row)."""
    words = Dictionary(INSIDE[data], at)
    crc, of, start = words.crc, words.ids, np.arange(len(words.ids))
    out = [(crc, of, words.row)]
    for k in range(1, longest):
        more = start < len(words.ids) - k
        more[more] = words.row[start[more]] == words.row[start[more] + k]
        start = start[more]
        tuples, of = np.unique(of[more] * words.size + words.ids[start + k], return_inverse=True)
        crc = words.extend(crc[tuples // max(words.size, 1)], tuples % max(words.size, 1))
        out.append((crc, of, words.row[start]))
    return np.bincount(words.row, minlength=len(at) - 1), out


def slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = K.buffers(col)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def bucket_counts(texts: DataFrame, buckets: int = 10_000, longest: int = 3) -> list[int]:
    """How many features of all of ``texts(text)`` each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                for crc, of, _ in runs(data, at, longest)[1]:
                    np.add.at(total, crc % np.uint32(buckets), np.bincount(of, minlength=len(crc)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = [0] * buckets
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: list[int], target: list[int]) -> list[int]:
    """Each bucket's smoothed log ratio in thousandths, rounded down."""
    n, every, wanted = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (every + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(corpus, target, strict=True)]


def weights(docs: DataFrame, gains: list[int], longest: int = 3) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gains, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                per_row, found = runs(data, at, longest)
                features, weight = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for crc, of, row in found:
                    own = gain[crc % np.uint32(len(gain))][of]
                    features += np.bincount(row, minlength=j - i)
                    weight += np.bincount(row, weights=own, minlength=j - i).astype(np.int64)  # whole numbers below 2**53
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(per_row), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def importance_ranks(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 3, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs(doc_id, text)``; ``rank`` only where the row is drawn.

    Of the rows with ``least_words`` words, ``percent`` in a hundred are drawn, by the features of ``target(text)``. Ranks come from
    ranges of the score, so no window is larger than a range.
    """
    gains = gains_of(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    with Scratch(docs.sparkSession) as scratch:
        scored = weights(docs, gains, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        scored = scratch.keep(scratch.store(scored, "scores"))
        able, order = F.col("n_words") >= least_words, [F.desc("score"), F.asc_nulls_last("doc_id")]
        # equal rows may lie in several ranges; the copy's number tells them apart
        ranged = scored.where(able).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order, "copy").withColumn("part", F.spark_partition_id())
        ranged = scratch.keep(scratch.store(ranged, "ranges"))
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    wanted, passed, before = sum(n for _, n in sizes) * percent // 100, 0, []
    for part, n in sizes:
        before.append((part, passed))
        passed += n
    before = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before long"))  # a row for each partition
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order, "copy"))
    ranks = ranged.join(before, "part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranks.select(*columns, "rank").unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
