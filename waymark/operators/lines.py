"""Line geometry: densify, overlap share, noding, covered corridors, simplification, zones. (GEO-07..13, GEO-21, JOI-14, AGG-12)

Lines are points ``(line_id, seq, x, y)`` in metres; all orders are explicit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.graph import materialised
from waymark.operators.spatial import cell, finite, off_segment, over_cells

#: Pairs of segments that one step of a tile looks at.
BLOCK = 1 << 18
#: An end this near to a segment lies on it (metres).
TOUCH = 0.05


def segments(points: DataFrame) -> DataFrame:
    """``(line_id, seq, x1, y1, x2, y2, len, upto)``: pieces with the length before them."""
    w = Window.partitionBy("line_id").orderBy("seq")
    s = points.select("line_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    s = s.withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return s.withColumn("upto", F.sum("len").over(w) - F.col("len"))


def densify(points: DataFrame, n: int) -> DataFrame:
    """``n`` points at even fractions from start to end of each line. (GEO-07)

    Each segment makes the sample points that fall into it, so no line is gathered.
    """
    s = segments(points)
    whole = s.groupBy("line_id").agg(F.sum("len").alias("total"), F.max("seq").alias("last"))
    s = s.join(whole, "line_id").where("total > 0")
    step = F.col("total") / (n - 1)
    first, end = F.ceil(F.col("upto") / step - 1e-9).cast("int"), F.col("upto") + F.col("len")
    last = F.when(F.col("seq") == F.col("last"), n - 1).otherwise(F.ceil(end / step - 1e-9).cast("int") - 1)
    k = s.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("k") * step - F.col("upto"), F.col("len"))))
    t = F.coalesce(t, F.lit(0.0))
    return k.select("line_id", "k", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def near_lines(samples: DataFrame, others: DataFrame, reach: float) -> DataFrame:
    """``samples`` points that lie within ``reach`` of a segment of ``others``, once each. (GEO-06, JOI-06)

    A cell of less than ``reach`` across that a segment runs well into holds only such points, so most are told by their cell alone. The others
    are held against the segments around theirs.
    """
    size = reach / 1.5
    segs = materialised(segments(others).select("x1", "y1", "x2", "y2").distinct())
    own = materialised(samples.distinct().withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)}))
    # the middle of such a cell is at most reach - half a diagonal off
    sure = materialised(over_cells(segs, reach - 1.4144 * size - 1e-3, size).select("cx", "cy").distinct())
    rest = materialised(own.join(sure, ["cx", "cy"], "left_anti"))
    _, gap = off_segment(F.col("x"), F.col("y"))
    around = over_cells(segs, reach, size).join(rest.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    tested = rest.join(around.hint("merge"), ["cx", "cy"]).where(gap <= reach)
    return own.join(sure, ["cx", "cy"], "left_semi").select(*samples.columns).unionByName(tested.select(*samples.columns).distinct())


def overlap_share(lines: DataFrame, proven: DataFrame, n: int = 40, reach: float = 150.0) -> DataFrame:
    """``(line_id, share)``: the share of ``n`` samples of each line that lie near a proven line. (GEO-09)"""
    samples = densify(lines, n)
    near = near_lines(samples, proven, reach).groupBy("line_id").agg(F.count("*").alias("hits"))
    return samples.select("line_id").distinct().join(near, "line_id", "left").select("line_id", (F.coalesce("hits", F.lit(0)) / n).alias("share"))


def noded(points: DataFrame, size: float = 100.0, digits: int = 1) -> DataFrame:
    """Edges ``(src_x, src_y, dst_x, dst_y, weight)`` of the network: lines split at every crossing and touch, doubles dissolved. (GEO-11, GRA-01)

    Segments meet in grid cells. A segment is split where another crosses it, and at the other's ends that lie on it, which also
    splits collinear overlaps at the ends of the shared part. Nodes are rounded to 0.1 m half even.
    """
    s = segments(points).where("len > 0").select(F.concat_ws("/", "line_id", "seq").alias("id"), "x1", "y1", "x2", "y2")
    c = over_cells(s, 0.05, size)
    o = c.select("cx", "cy", *(F.col(x).alias(f"o{x}") for x in s.columns))
    # cells outnumber the segments by far, so neither side is broadcast; a pair that meets in several cells gives the same cuts in each
    met = c.join(o.hint("merge"), ["cx", "cy"]).where("id <> oid")
    rx, ry, qx, qy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    cross = rx * qy - ry * qx
    wx, wy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    t, u = F.try_divide(wx * qy - wy * qx, cross), F.try_divide(wx * ry - wy * rx, cross)
    inner = F.when((F.abs(cross) > 1e-12) & t.between(0, 1) & u.between(0, 1), t)
    on = []
    for ex, ey in (("ox1", "oy1"), ("ox2", "oy2")):
        along = ((F.col(ex) - F.col("x1")) * rx + (F.col(ey) - F.col("y1")) * ry) / (rx * rx + ry * ry)
        off = F.hypot(F.col(ex) - (F.col("x1") + along * rx), F.col(ey) - (F.col("y1") + along * ry))
        on.append(F.when(along.between(0, 1) & (off <= 0.05), along))
    cuts = met.select("id", "x1", "y1", "x2", "y2", F.explode(F.array_compact(F.array(inner, *on))).alias("t"))
    ends = s.select("id", "x1", "y1", "x2", "y2", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    at = cuts.union(ends).select("id", F.bround(F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), digits).alias("x"), F.bround(F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1")), digits).alias("y"), "t")
    at = at.groupBy("id", "x", "y").agg(F.min("t").alias("t"))
    w = Window.partitionBy("id").orderBy("t", "x", "y")
    e = at.select("x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null and (x <> x2 or y <> y2)")
    a, b = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    e = e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return e.select(F.col("a.x").alias("src_x"), F.col("a.y").alias("src_y"), F.col("b.x").alias("dst_x"), F.col("b.y").alias("dst_y"), F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("weight"))


def rounded(v: np.ndarray, unit: float) -> np.ndarray:
    """``v`` in whole ``1 / unit``, half even by its shortest decimal, as ``bround`` does."""
    low = np.floor(v * unit)
    half = (2 * low + 1) / (2 * unit)
    up = v > half
    even = np.flatnonzero(v == half)
    up[even] = low[even] % 2 == 1
    return low.astype(np.int64) + up


def merged(*codes: np.ndarray) -> np.ndarray:
    """The distinct codes in order."""
    c = np.concatenate(codes)
    c.sort()
    return c[np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))] if len(c) else c


def tile_nodes(cx: int, cy: int, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, size: float, unit: float):
    """Noding of the segments that come near the tile, for the nodes inside it, a block of segments at a time.

    Gives the distinct edges between nodes of the tile as ``(number, length)`` and, for each segment with a node there, its first and last node:
    ``(segment, place along it, x and y of the first, x and y of the last)``. A segment's nodes go one way on both axes, so the sum of
    their steps orders them, and those of one tile follow each other.
    """
    bits = (math.ceil(size * unit) + 3).bit_length()
    bx, by = (math.floor(c * size * unit) - 1 for c in (cx, cy))
    rx, ry = x2 - x1, y2 - y1
    sx, sy = np.sign(rx).astype(np.int64), np.sign(ry).astype(np.int64)
    margin = TOUCH + 1 / unit
    inside = lambda x, y: (x >= cx * size - margin) & (x <= (cx + 1) * size + margin) & (y >= cy * size - margin) & (y <= (cy + 1) * size + margin)
    ends = np.unique(np.concatenate([np.stack([x1, y1]), np.stack([x2, y2])], axis=1), axis=1)
    ex, ey = ends[:, inside(ends[0], ends[1])]
    found, waiting, held, parts = np.empty(0, np.int64), [], 0, []
    rows = max(1, BLOCK // len(x1))
    for b in range(0, len(x1), rows):
        s = slice(b, b + rows)
        px, py, dx, dy = (a[s, None] for a in (x1, y1, rx, ry))
        with np.errstate(all="ignore"):
            cross = dx * ry - dy * rx
            wx, wy = x1 - px, y1 - py
            t, u = (wx * ry - wy * rx) / cross, (wx * dy - wy * dx) / cross
            own, at = np.nonzero((np.abs(cross) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
            along = ((ex - px) * dx + (ey - py) * dy) / (dx * dx + dy * dy)
            off = np.hypot(ex - (px + along * dx), ey - (py + along * dy))
            on, end = np.nonzero((along >= 0) & (along <= 1) & (off <= TOUCH))
        n = np.arange(len(px))
        seg = np.concatenate([own, on, n, n])
        t = np.concatenate([t[own, at], along[on, end], np.zeros(len(n)), np.ones(len(n))])
        x, y = x1[s][seg] + t * rx[s][seg], y1[s][seg] + t * ry[s][seg]
        near = np.flatnonzero(inside(x, y))
        seg, ix, iy = seg[near], rounded(x[near], unit), rounded(y[near], unit)
        near = np.flatnonzero((np.floor(ix / unit / size) == cx) & (np.floor(iy / unit / size) == cy))
        if not len(near):
            continue
        seg, ix, iy = seg[near], ix[near] - bx, iy[near] - by
        step = sx[s][seg] * ix + sy[s][seg] * iy + (2 << bits)
        code = merged((((seg << bits + 2 | step) << bits) | ix) << bits | iy)
        node, seg = code & (1 << 2 * bits) - 1, code >> 3 * bits + 2
        same = seg[1:] == seg[:-1]
        a, z = node[:-1][same], node[1:][same]
        waiting.append(merged(np.minimum(a, z) << 2 * bits | np.maximum(a, z)))
        held += len(waiting[-1])
        if held > len(found) + 4 * BLOCK:
            found, waiting, held = merged(found, *waiting), [], 0
        first, last = np.flatnonzero(np.concatenate([[True], ~same])), np.flatnonzero(np.concatenate([~same, [True]]))
        low = (1 << bits) - 1
        ix, iy, seg = (node >> bits) + bx, (node & low) + by, seg[first] + b
        parts.append((seg, sx[seg] * ix[first] + sy[seg] * iy[first], ix[first] / unit, iy[first] / unit, ix[last] / unit, iy[last] / unit))
    found = merged(found, *waiting)
    a, z = found >> 2 * bits, found & (1 << 2 * bits) - 1
    x = [((c >> bits) + bx) / unit for c in (a, z)]
    y = [((c & (1 << bits) - 1) + by) / unit for c in (a, z)]
    return (len(found), float(np.hypot(x[1] - x[0], y[1] - y[0]).sum())), parts


def noded_total(points: DataFrame, size: float = 250.0, digits: int = 1) -> DataFrame:
    """``(edges, weight)``: the number and length of the edges that ``noded`` gives, without a row for each crossing. (GEO-11)

    Crossings grow with the square of the lines. They are found, ordered and told from doubles within the tile of their rounded node, and
    only each tile's sums and the first and last node of each segment in it leave the task; the edges from tile to tile are drawn from these.
    """
    unit = 10.0**digits
    if (math.ceil(size * unit) + 3).bit_length() > 14:
        raise ValueError("tiles of more than 16,000 steps of rounding are not supported")
    s = finite(finite(segments(points), "x1", "y1"), "x2", "y2").where("len > 0").select(F.concat_ws("/", "line_id", "seq").alias("id"), "x1", "y1", "x2", "y2")
    many = 3 * points.sparkSession.sparkContext.defaultParallelism
    # a node is rounded into a tile from up to a step off it
    tiles = over_cells(s.repartition(many), TOUCH + 1 / unit, size).repartition(4 * many, "cx", "cy")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cx, cy = key[0].as_py(), key[1].as_py()
        (edges, weight), parts = tile_nodes(cx, cy, *(rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")), size, unit)
        seg, at, *ends = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 6
        none, one = pa.nulls(len(seg), pa.int64()), pa.nulls(1, pa.int64())
        kinds = {"cx": pa.array([cx]), "cy": pa.array([cy]), "edges": pa.array([edges]), "weight": pa.array([weight])}
        cols = {"id": pa.concat_arrays([rows["id"].combine_chunks().take(pa.array(seg)).cast(pa.string()), pa.nulls(1, pa.string())]), "at": pa.concat_arrays([pa.array(at), one])}
        cols |= {c: pa.concat_arrays([pa.array(v, pa.float64()), one.cast(pa.float64())]) for c, v in zip(("x", "y", "lx", "ly"), ends, strict=True)}
        return pa.table(cols | {c: pa.concat_arrays([none.cast(v.type), v]) for c, v in kinds.items()})

    found = tiles.groupBy("cx", "cy").applyInArrow(run, "id string, at long, x double, y double, lx double, ly double, cx long, cy long, edges long, weight double")
    # a tile's sums have no id, a segment's nodes no tile
    w = Window.partitionBy("id", "cx", "cy").orderBy("at")
    a, b = F.struct(F.col("lx").alias("x"), F.col("ly").alias("y")), F.struct(F.lead("x").over(w).alias("x"), F.lead("y").over(w).alias("y"))
    found = found.select("id", "edges", "weight", a.alias("a"), b.alias("b")).where("id is null or b.x is not null")
    found = found.select(F.when(F.col("id").isNotNull(), F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("e"), "edges", "weight")
    found = found.groupBy("e").agg(F.sum("edges").alias("edges"), F.sum("weight").alias("weight"))
    across = F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y"))
    return found.agg(F.coalesce(F.sum(F.coalesce("edges", F.lit(1))), F.lit(0)).alias("edges"), F.sum(F.coalesce("weight", across)).alias("weight"))


def simplify(points: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker per line; ends stay. One line is one group. (GEO-21)"""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        xy = g[["x", "y"]].to_numpy()
        keep, stack = np.zeros(len(g), bool), [(0, len(g) - 1)]
        keep[[0, -1]] = True
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d = xy[b] - xy[a]
            n = np.hypot(*d)
            r = xy[a + 1 : b] - xy[a]
            off = np.abs(r[:, 0] * d[1] - r[:, 1] * d[0]) / n if n else np.hypot(r[:, 0], r[:, 1])
            i = int(np.argmax(off))
            if off[i] > tolerance:
                keep[a + 1 + i] = True
                stack += [(a, a + 1 + i), (a + 1 + i, b)]
        return g[keep]

    return points.groupBy("line_id").applyInPandas(run, points.schema)


def zone_of_lines(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """``(line_id, zone)``: inside, crossing or outside a polygon, by all of the lines' pieces. (JOI-14)

    Inside: every vertex is, and no piece crosses an edge. Crossing: any vertex is inside, or any piece meets an edge, also between two
    vertices outside. A line of one vertex is judged by it.
    """
    w = Window.partitionBy("line_id").orderBy("seq")
    x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "_x2", "_y2"))
    meets, cuts = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)  # noqa: B023, E731
        other = lambda px, py: (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        s, t = side(x1, y1) * side(x2, y2), other(ax, ay) * other(bx, by)
        boxes = (F.least(x1, x2) <= max(ax, bx)) & (F.greatest(x1, x2) >= min(ax, bx)) & (F.least(y1, y2) <= max(ay, by)) & (F.greatest(y1, y2) >= min(ay, by))
        cuts = cuts | ((s < 0) & (t < 0))
        meets = meets | ((s <= 0) & (t <= 0) & boxes)
    pieces = points.select("line_id", "x", "y", F.lead("x").over(w).alias("_x2"), F.lead("y").over(w).alias("_y2"))
    pieces = pieces.select("line_id", geo.in_ring(x1, y1, ring).alias("in"), F.coalesce(cuts, F.lit(False)).alias("cuts"), F.coalesce(meets, F.lit(False)).alias("meets"))
    z = pieces.groupBy("line_id").agg(F.bool_and(F.col("in") & ~F.col("cuts")).alias("within"), F.bool_or(F.col("in") | F.col("meets")).alias("touches"))
    return z.select("line_id", F.when(F.col("within"), "inside").when(F.col("touches"), "crossing").otherwise("outside").alias("zone"))


def voronoi_cells(seeds: list[tuple[int, float, float]], hull: list[tuple[float, float]]) -> dict[int, list[tuple[float, float]]]:
    """The Voronoi cells of a few seeds inside a convex hull, by cutting the hull with the seeds' bisectors. (GEO-16)

    Coincident seeds leave the cell to the first of them.
    """
    out: dict[int, list[tuple[float, float]]] = {}
    taken: list[tuple[float, float]] = []
    for i, x, y in seeds:
        ring = [] if (x, y) in taken else list(hull)
        taken.append((x, y))
        for _, ox, oy in seeds:
            if (ox, oy) == (x, y):
                continue
            nx, ny, m = ox - x, oy - y, (ox**2 + oy**2 - x**2 - y**2) / 2
            side = [m - (px * nx + py * ny) for px, py in ring]
            cut: list[tuple[float, float]] = []
            for (p, q), (s, t) in zip(zip(ring, ring[1:] + ring[:1], strict=True), zip(side, side[1:] + side[:1], strict=True), strict=True):
                if s >= 0:
                    cut.append(p)
                if s * t < 0:
                    f = s / (s - t)
                    cut.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
            ring = cut
        out[i] = ring
    return out


def covered_last(points: DataFrame, corridor: float = 25.0, least: float = 60.0, sample: int = 50) -> DataFrame:
    """Lines longest first; each keeps its samples that no longer line covers, if they make ``least`` metres. (GEO-13)

    The corridor of a line is the whole line, also where it is itself covered, so that all lines are judged at once.
    """
    total = segments(points).groupBy("line_id").agg(F.sum("len").alias("total"))
    samples = densify(points, sample).join(total, "line_id")
    s = segments(points).join(total.select("line_id", F.col("total").alias("other_total")), "line_id").select(F.col("line_id").alias("other"), "other_total", "x1", "y1", "x2", "y2")
    span = lambda a, b: F.sequence(cell(F.least(a, b) - corridor, corridor * 8), cell(F.greatest(a, b) + corridor, corridor * 8))
    s = s.withColumn("cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"))))
    p = samples.withColumns({"cx": cell(F.col("x"), corridor * 8), "cy": cell(F.col("y"), corridor * 8)})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy))), F.lit(0.0))
    gap = F.hypot(F.col("x") - (F.col("x1") + t * dx), F.col("y") - (F.col("y1") + t * dy))
    longer = (F.col("other_total") > F.col("total")) | ((F.col("other_total") == F.col("total")) & (F.col("other") < F.col("line_id")))
    hit = p.join(s, ["cx", "cy"]).where(longer & (gap <= corridor)).select("line_id", "k").distinct()
    rest = samples.join(hit, ["line_id", "k"], "left_anti").groupBy("line_id", "total").agg(F.count("*").alias("free"))
    return rest.select("line_id", (F.col("free") / sample * F.col("total")).alias("kept_m")).where(F.col("kept_m") >= least)
