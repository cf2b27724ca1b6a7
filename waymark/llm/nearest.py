"""Operator 9: approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected on ``m`` random Gaussian directions (2-stable: a projected squared distance is the true one times a
chi-square variable of ``m`` degrees). A kd-tree over the projections gives its leaves in order of projected distance; in rounds, the
vectors in them that the test below does not rule out are verified. With the k-th best true distance d known so far and the next projected distance r, the search
stops when ``P(chi2_m <= r**2 / d**2) >= sure``: a nearer vector would then have been met already with probability ``sure``.

Every row is indexed, once: a task cuts its rows into blocks of at most BLOCK, each with a tree of its own, and writes the trees' leaves, a
row each. Queries go to all leaves in batches of at most QUERY_BYTES, with a first bound of d: the k-th best among a sample of
at most SAMPLE rows and an eighth of all, so that no leaf verifies or returns what the sample already beats. The sample gives
bounds and no result: each row of the result is found through its leaf. What the leaves return is merged. Vectors are shuffled
once. The vectors of the test tables are nearly uniform on a sphere of 64 dimensions, where the tenth neighbour is at 0.79 of the
median distance, so about half of all pairs is verified.

Cases. Vectors that are null, empty, zero, or hold null or non-finite components take no part. A vector is compared with those of
its own length only, as there is no distance to others. Distances are summed in double precision over the differences. Ties go to
the smaller id; repeated rows of an id are one candidate each, but ask once, the least vector for the id; a query never finds rows of its own id. With fewer
candidates than k, all are returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Scratch

BLOCK, LEAF = 4096, 64
#: Queries that a block is searched for at once, and leaves verified between two looks at the stopping test.
AT_ONCE, ROUND = 256, 4
#: Bytes of one batch of queries, and rows of the sample that gives their first bounds: what the driver and each task hold.
QUERY_BYTES, SAMPLE = 16 << 20, 4096


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """P(chi2_m <= x) for even m."""
    h = np.asarray(x, float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total += term
    return 1 - np.exp(-h) * total


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(np.array(mid), m) < p else (lo, mid)
    return hi


def tree_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree by median splits on the widest axis: order of the points, leaf edges, and the leaves' bounding boxes."""
    order = np.arange(len(points))
    leaves: list[tuple[int, int]] = []
    stack = [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= LEAF:
            leaves.append((a, b))
            continue
        own = points[order[a:b]]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
        stack += [(a, a + mid), (a + mid, b)]
    leaves.sort()
    edges = np.array([a for a, _ in leaves] + [len(points)])
    low = np.array([points[order[a:b]].min(0) for a, b in leaves])
    high = np.array([points[order[a:b]].max(0) for a, b in leaves])
    return order, edges, low, high


def verified(points: np.ndarray, queries: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Distances of queries (rows) to points where they are wanted, else infinite."""
    out = np.full(wanted.shape, np.inf)
    q, p = np.nonzero(wanted)
    out[q, p] = np.sqrt(((points[p] - queries[q]) ** 2).sum(1))
    return out


def directions(width: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, m))


def search_leaves(ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, edges: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, sure: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place of the query, place, distance) of the at most ``k`` nearest found for each query within its bound, and how many pairs were verified.

    Rows lie in order of the leaves that start at ``edges``; ``points`` are their projections.
    """
    m = points.shape[1]
    onto = directions(vectors.shape[1], m, seed)
    low, high = np.minimum.reduceat(points, edges[:-1]), np.maximum.reduceat(points, edges[:-1])
    limit, tried = chi_square_quantile(sure, m), 0
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(queries), AT_ONCE):
        own, own_ids, bound = queries[s : s + AT_ONCE], query_ids[s : s + AT_ONCE], bounds[s : s + AT_ONCE].copy()
        wanted = own @ onto
        # projected distance to a leaf's box: a leaf is met when the incremental search reaches that distance
        reach = sum(np.maximum(0, np.maximum(low[None, :, j] - wanted[:, None, j], wanted[:, None, j] - high[None, :, j])) ** 2 for j in range(m))
        turn = np.argsort(reach, axis=1, kind="stable")
        far = np.full((len(own), len(ids)), np.inf)
        for r in range(0, len(edges) - 1, ROUND):
            now = turn[:, r : r + ROUND]
            go = np.take_along_axis(reach, now, 1) < limit * bound[:, None] ** 2
            if not go.any():
                break
            for leaf in np.unique(now[go]):
                a, b = edges[leaf], edges[leaf + 1]
                ask = np.flatnonzero((go & (now == leaf)).any(1))
                near = ((points[a:b][None] - wanted[ask][:, None]) ** 2).sum(2) < limit * bound[ask][:, None] ** 2
                tried += int(near.sum())
                d = verified(vectors[a:b], own[ask], near)
                far[ask, a:b] = np.where(own_ids[ask][:, None] == ids[None, a:b], np.inf, d)
            if len(ids) >= k:
                bound = np.minimum(bound, np.partition(far, k - 1, axis=1)[:, k - 1])
        q, p = np.nonzero(np.isfinite(far) & (far <= bound[:, None]))
        best = np.lexsort((ids[p], far[q, p], q))
        q, p = q[best], p[best]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, p = q[place < k], p[place < k]
        found.append((q + s, p, far[q, p]))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), tried


def first_found(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place, distance) of each query's ``k`` nearest among some rows, of all with fewer."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for s in range(0, len(queries), AT_ONCE):
        own = queries[s : s + AT_ONCE]
        rough = np.maximum(0, (own**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * own @ vectors.T)
        other = query_ids[s : s + AT_ONCE][:, None] != ids[None]
        rough[~other] = np.inf
        best = np.zeros(rough.shape, bool)
        np.put_along_axis(best, np.argpartition(rough, min(k, len(ids)) - 1, axis=1)[:, :k] if len(ids) else np.zeros((len(own), 0), np.int64), True, axis=1)
        q, p = np.nonzero(best & other)
        found.append((q + s, p, np.sqrt(((vectors[p] - own[q]) ** 2).sum(1))))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def bounds_of(n: int, q: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """The largest distance of each query that has found ``k``; infinite for the others."""
    out = np.zeros(n)
    np.maximum.at(out, q, d)
    return np.where(np.bincount(q, minlength=n) >= k, out, np.inf)


def by_length(rows: pa.RecordBatch | pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row numbers, matrix) of the vectors ``(vec_id, at, v)`` of each length."""
    if isinstance(rows, pa.Table):
        rows = rows.combine_chunks()
    ids, at, vectors = (rows["vec_id"].to_numpy(), rows["at"].to_numpy(), rows["v"].combine_chunks() if isinstance(rows, pa.Table) else rows["v"])
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for w in np.unique(size):
        own = np.flatnonzero(size == w)
        out[int(w)] = ids[own], at[own], vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
    return out


LEAVES = "width int, ids array<long>, at array<long>, v array<double>, p array<double>"


def leaves_of(rows: DataFrame, m: int, seed: int) -> DataFrame:
    """The leaves of the trees over blocks of ``rows(vec_id, at, v)``: LEAVES, the vectors and their projections end to end."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in range(0, part.num_rows, BLOCK):
                for w, (ids, at, matrix) in by_length(part.slice(s, BLOCK)).items():
                    points = matrix @ directions(w, m, seed)
                    order, edges, _, _ = tree_of(points)
                    run_of = lambda values, each: pa.ListArray.from_arrays(pa.array((edges * each).astype(np.int32)), pa.array(np.ascontiguousarray(values[order]).ravel()))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edges) - 1, w, np.int32)), run_of(ids, 1), run_of(at, 1), run_of(matrix, w), run_of(points, m)], ["width", "ids", "at", "v", "p"])

    return rows.mapInArrow(run, LEAVES)


def groups(batch: pa.RecordBatch, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, ids, row numbers, vectors, projections, edges) of consecutive leaves of one width, of about BLOCK rows."""
    width, size = batch["width"].to_numpy(), batch["ids"].value_lengths().to_numpy()
    start = 0
    while start < len(width):
        same = np.flatnonzero(width[start:] != width[start])
        upto = np.searchsorted(np.cumsum(size[start:]), BLOCK, side="right")
        end = start + max(1, min(int(upto), int(same[0]) if len(same) else len(width)))
        flat = lambda c: batch[c].slice(start, end - start).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        w = int(width[start])
        yield w, flat("ids"), flat("at"), flat("v").reshape(-1, w), flat("p").reshape(-1, m), np.concatenate(([0], np.cumsum(size[start:end])))
        start = end


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, m: int = 16, sure: float = 0.95, seed: int = 1) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides, the ``k`` nearest others found."""
    spark, usual = vectors.sparkSession, usable(vectors, id_col, vec_col)
    with Scratch(spark) as scratch:
        n, asking, widest = usual.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK))
        # dealt by row, so equal vectors and ids do not gather in one block
        rows = scratch.store(usual.repartition(blocks, F.monotonically_increasing_id()).withColumn("at", F.monotonically_increasing_id()).select("vec_id", "at", "v"), "vectors")
        leaves = scratch.keep(scratch.store(leaves_of(rows, m, seed), "leaves"))
        asked = scratch.store(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.lit(0).cast("long").alias("at"), "v"), "asked")
        batches = max(1, -(-asking * 8 * (widest or 1) // QUERY_BYTES))
        few = min(SAMPLE, n // 8)
        # one row in n / few on average, by a hash of 62 bits
        drawn = rows.where(F.shiftright(F.xxhash64("vec_id", F.lit(seed)), 2).bitwiseAND((1 << 62) - 1) < F.lit((few << 62) // max(n, 1)))
        sample = by_length(drawn.limit(few).toArrow())
        found = []
        for batch in range(batches):
            queries = {}
            for w, (ids, _, matrix) in by_length(asked.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(batches)) == batch).toArrow()).items():
                of, _, points = sample.get(w, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, w))))
                q, _, d = first_found(of, points, ids, matrix, k)
                queries[w] = ids, matrix, bounds_of(len(ids), q, d, k)
            shared = spark.sparkContext.broadcast(queries)

            def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                for part in parts:
                    for w, ids, at, matrix, points, edges in groups(part, m):
                        if w in shared.value:
                            q, p, d, _ = search_leaves(ids, matrix, points, edges, *shared.value[w], k, sure, seed)
                            yield pa.RecordBatch.from_arrays([pa.array(shared.value[w][0][q]), pa.array(ids[p]), pa.array(d), pa.array(at[p])], ["query_id", "vec_id", "score", "at"])

            found.append(leaves.mapInArrow(run, "query_id long, vec_id long, score double, at long"))
    out = functools.reduce(DataFrame.union, found)
    # each group of leaves gives at most k rows a query, so the merge is bounded
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "at")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
