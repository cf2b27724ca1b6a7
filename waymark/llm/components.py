"""Connected components of an edge table, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, small

#: Edges up to which (16 MB) one task draws the components; beyond it they are drawn by joins.
ONE_TASK = 1_000_000


def drawn(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of some edges, ascending, and the least id that each reaches."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        old = label.copy()
        least = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, label[end], least)  # the root of each end hooks to the lesser root
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == old).all():
            return ids, ids[label]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(sid, label)`` for every end of the stored table ``edges(a, b)``: the least id that it reaches.

    Up to ONE_TASK edges are one task's. More take rounds of two joins, each stored: a node takes the least label among its
    neighbours, then the label of its label. Hubs cost nothing extra: minima are combined before the shuffle, and AQE splits skewed
    joins. Rounds grow as the logarithm of the longest path. Loops and repeated edges change nothing; an empty table gives an empty one.
    """
    arcs = edges.select("a", "b").where("a <> b")
    if arcs.limit(ONE_TASK + 1).count() <= ONE_TASK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
            if held:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, drawn(*map(np.concatenate, zip(*held, strict=True))))), ["sid", "label"])

        return scratch.store(arcs.coalesce(1).mapInArrow(run, "sid long, label long"), "labels")
    return by_rounds(arcs, scratch)


def by_rounds(arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by joins, without a bound on the edges."""
    both = scratch.store(arcs.union(arcs.select("b", "a")).distinct(), "arcs")
    labels = scratch.store(both.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("m")).select("sid", F.least("sid", "m").alias("label"), F.lit(-1).cast("long").alias("old")), "labels")
    while True:
        near = both.join(small(labels.select("sid", "label")), both["b"] == F.col("sid")).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.drop("old").join(near, F.col("sid") == F.col("a")).select("sid", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = small(labels.select(F.col("sid").alias("up"), F.col("label").alias("upper")))
        jumped = hooked.join(up, hooked["label"] == up["up"], "left").select("sid", F.least("label", F.coalesce("upper", "label")).alias("label"), "old")
        last, labels = labels, scratch.store(jumped, "labels")
        scratch.drop(last)
        if labels.where("label <> old").isEmpty():
            scratch.drop(both)
            return labels.select("sid", "label")
