"""Operator 8: quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in standardised features of its whole text. It is learned from preference pairs (a row labelled 1 is
preferred to a row labelled 0) by the logistic loss on the pairs' feature differences, which is the Bradley-Terry model. The
score at which a text counts as good is the quantile of the training scores at the share of rows labelled 0; the logistic of
the distance to it is the result, so ``score >= 0.5`` is the threshold by score quantile.

Features come from one pass over the bytes (shares of byte classes, word lengths, line and sentence lengths, distinct words,
shingles and lines), so labels, language, source and ids are never inputs. They are stored once as a narrow table. Fitting
takes at most ``sample`` labelled rows, drawn by a hash of the id, and ``pairs`` pairs.

Cases. A null text is scored as an empty one. Labels that are null are ignored. If no row, or only one kind of row, is labelled, every
score is 0.5. Rows are kept as they are, repeated ones too; other columns of either table are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import kernel as K
from waymark.llm.common import crc_of_id, draw, draw_bound, stored

CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 plain punctuation, 5 other ASCII, 6 not ASCII, 7 newline
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 6
CLASS[[32, 9, 11, 12, 13]] = 3
CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
CLASS[10] = 7
KINDS = 8
#: Bytes that get a share of their own.
MARKS = b"|!#$%&*@=/_.,"
N_FEATURES = KINDS + len(MARKS) + 16


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    byte = np.bincount(row * KINDS + CLASS[data], minlength=n * KINDS).reshape(n, KINDS)
    count = lambda mask: np.bincount(row[mask], minlength=n)
    total = np.maximum(size, 1)
    out = [byte / total[:, None], *(count(data == m)[:, None] / total[:, None] for m in MARKS)]
    w = K.Words(data, at)
    words = np.bincount(w.row, minlength=n)
    some = np.maximum(words, 1)
    length = w.end - w.start
    per_word = lambda mask: np.bincount(w.row[mask], minlength=n) / some
    mean = np.bincount(w.row, weights=length, minlength=n) / some
    var = np.bincount(w.row, weights=length.astype(float) ** 2, minlength=n) / some - mean**2
    first, last = (data[w.start], data[w.end - 1]) if len(w) else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    second = data[np.minimum(w.start + 1, len(data) - 1)] if len(w) else first
    upper = CLASS[first] == 1
    distinct_words = np.bincount(K.distinct(w.hash, w.row)[1], minlength=n)
    grams, of = K.shingles(w.hash, w.row, 3)
    n_grams = np.bincount(of, minlength=n)
    distinct_grams = np.bincount(K.distinct(grams, of)[1], minlength=n)
    # lines: the words between newlines as one hash
    breaks = np.cumsum(data == 10) if len(data) else np.zeros(0, np.int64)
    line = w.row * (len(data) + 1) + breaks[w.start] if len(w) else np.zeros(0, np.int64)
    head = K.heads(line)
    with np.errstate(over="ignore"):
        text = np.add.reduceat(w.hash * (np.arange(len(w)) - np.repeat(head, np.diff(np.append(head, len(w)))) + 1).astype(K.U), head) if len(w) else np.zeros(0, K.U)
    lines = np.bincount(w.row[head], minlength=n)
    distinct_lines = np.bincount(K.distinct(text, w.row[head])[1], minlength=n)
    sentences = count(data == ord("."))
    out += [
        x[:, None]
        for x in (
            np.log1p(words), mean, np.sqrt(np.maximum(var, 0)), per_word(length == 1), per_word(length > 15),
            per_word(upper & (CLASS[second] != 1)), per_word(upper & (CLASS[second] == 1)), per_word(CLASS[last] == 5), per_word(CLASS[first] == 5),
            np.log1p(words / np.maximum(sentences, 1)), np.log1p(words / np.maximum(lines, 1)),
            distinct_words / some, distinct_words / np.sqrt(some), distinct_grams / np.maximum(n_grams, 1), distinct_lines / np.maximum(lines, 1),
            np.log1p(lines),
        )
    ]
    return np.hstack(out)


def feature_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, f)`` for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in K.slices(batch.column(1)):
                f = features(data, at).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), K.ragged(f.ravel(), np.full(j - i, N_FEATURES), pa.float32())], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f array<float>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def expand(self, f: np.ndarray) -> np.ndarray:
        """Standardised features, and their squares, so that a share may be bad at both ends."""
        z = np.clip((f - self.mean) / self.spread, -6, 6)
        return np.hstack([z, z * z / 6])

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.expand(f) @ self.weights - self.threshold) * self.scale, -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, l2: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w (better - worse))) + l2 |w|**2, by accelerated gradient steps."""
    x = better - worse
    w = v = np.zeros(x.shape[1])
    rate = 4 / (np.linalg.norm(x, 2) ** 2 / len(x) + 8 * l2)
    for t in range(steps):
        g = -(x / (1 + np.exp(np.clip(x @ v, -30, 30)))[:, None]).mean(0) + 2 * l2 * v
        new = v - rate * g
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def fit(table: DataFrame, labels: DataFrame, usable: Column, sample: int = 20_000, pairs: int = 40_000) -> Model | None:
    """Learn from ``labels(doc_id, quality)`` of the rows of ``table(doc_id, f)`` that are ``usable``; None without both kinds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(usable & F.col("quality").isin(0, 1))
    n = marks.count()
    marks = marks.where(draw("doc_id", seed=29) < draw_bound(1.2 * sample, n)).distinct()
    rows = table.join(marks, "doc_id").select("quality", "f").orderBy(F.xxhash64("doc_id", F.lit(31)), "quality", "f").limit(sample).toArrow()
    if not rows.num_rows:
        return None
    y = rows["quality"].to_numpy()
    f = rows["f"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    model = Model(f.mean(0), f.std(0) + 1e-6, np.zeros(0), 0.0, 1.0)
    x = model.expand(f)
    rng = np.random.default_rng(5)
    model.weights = bradley_terry(x[rng.choice(good, pairs)], x[rng.choice(bad, pairs)])
    s = x @ model.weights
    model.threshold = float(np.quantile(s, len(bad) / len(y)))
    return model


def score_quality(table: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``table(doc_id, f)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)
            s = model.score(f) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows whose crc32(doc_id) mod ``folds`` is ``out`` are held out of the fit."""
    table = stored(feature_table(docs), "features")
    fold = crc_of_id(F.col("doc_id")) % folds
    scored = score_quality(table, fit(table, labels, fold != out))
    return scored.select("doc_id", F.coalesce(fold == out, F.lit(False)).alias("held_out"), "score", "predicted")
