"""Resolution by ordered greedy folds and fixpoints. (RES-02, RES-06, RES-08, OPT-01, STR-15)

A greedy fold depends on its order. Same-name merging decides in rounds of cells; spelling groups and tours take one block or one tour, small by
nature, as a task's unit.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.access import finite
from waymark.operators.graph import discard, materialised
from waymark.operators.spatial import cell


def greedy_seeds(places: DataFrame, radius: float) -> DataFrame:
    """``(id, seed)`` of ``places(id, name, x, y)``: in id order a place joins the first seed of its name within ``radius``, else it is one. (RES-02)

    Decided in rounds, many at a time, with the result of the loop over all rows in id order. Cells are so small that two rows of one name in
    one cell are within the radius: a cell has at most one seed, and only its least open row may become one. That row does so once no cell around has a
    lesser open row; the seeds of a round then take the open rows near them. So rows never meet in pairs, and a name that many rows share is spread
    over its cells. Rows without a finite place stand alone. Ids are unique.
    """
    side, whole = radius / math.sqrt(2) * 0.999, finite(places.select("id", "x", "y", F.to_json(F.struct("name")).alias("key")))
    rows = materialised(whole.withColumns({"cx": cell(F.col("x"), side), "cy": cell(F.col("y"), side)}))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3))))
    spread = lambda df: df.withColumn("to", around).withColumns({"cx": F.col("cx") + F.col("to.a"), "cy": F.col("cy") + F.col("to.b")}).drop("to")
    near = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= radius
    seeds = materialised(rows.select(F.col("id").alias("seed"), F.col("x").alias("sx"), F.col("y").alias("sy"), "key", "cx", "cy").where("false"))
    left = rows
    while not left.isEmpty():
        least = materialised(left.groupBy("key", "cx", "cy").agg(F.min(F.struct("id", "x", "y")).alias("m")).select("key", "cx", "cy", "m.*"))
        lesser = spread(least.select("key", "cx", "cy", F.col("id").alias("other"))).groupBy("key", "cx", "cy").agg(F.min("other").alias("first"))
        new = least.join(lesser, ["key", "cx", "cy"]).where("id = first").select(F.col("id").alias("seed"), F.col("x").alias("sx"), F.col("y").alias("sy"), "key", "cx", "cy")
        new = materialised(new)
        new.write.mode("append").parquet(seeds.stored_at)
        taken = left.join(spread(new), ["key", "cx", "cy"]).where(near).select("id").distinct()
        rest = materialised(left.join(taken, "id", "left_anti"))
        discard(least, new, *([left] if left is not rows else []))
        left = rest
    every = places.sparkSession.read.schema(seeds.schema).parquet(seeds.stored_at)
    joined = rows.join(spread(every), ["key", "cx", "cy"]).where(near).groupBy("id").agg(F.min("seed").alias("seed"))
    alone = places.select("id").join(rows.select("id"), "id", "left_anti").select("id", F.col("id").alias("seed"))
    return materialised(joined.unionByName(alone))


def merge_same_name(places: DataFrame, radius: float = 3000.0) -> DataFrame:
    """``places(id, name, x, y, n)`` merged by greedy seeds: in id order a place joins the first seed of its name within ``radius``. (RES-02, AGG-07)

    Not transitive: distances are to the seed, not to its members. The merged place sums ``n`` and takes the mean of distinct points.
    """
    own = places.select("id", "name", "x", "y", "n").join(greedy_seeds(places, radius), "id")
    sums = own.groupBy("seed").agg(F.first("name").alias("name"), F.sum("n").alias("n"), F.count("*").alias("members"))
    centre = own.select("seed", "x", "y").distinct().groupBy("seed").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return sums.join(centre, "seed").select(F.col("seed").alias("id"), "name", "x", "y", "n", "members")


def spelling_groups(names: DataFrame, cutoff: float = 0.80, apart: float = 4000.0) -> DataFrame:
    """``names(block, name, x, y)`` with the first spelling that each is like: a single pass in name order within a block. (RES-06, STR-06)

    A name joins a group if its similarity to the group's first spelling reaches ``cutoff`` and the two are not known to be
    more than ``apart`` from each other.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        firsts: list[tuple[str, float | None, float | None]] = []
        out = []
        for r in g.sort_values("name").itertuples():
            own = None
            for name, x, y in firsts:
                known = not any(v is None or math.isnan(v) for v in (x, y, r.x, r.y))
                if known and math.hypot(r.x - x, r.y - y) > apart:
                    continue
                if SequenceMatcher(None, name, r.name).ratio() >= cutoff:
                    own = name
                    break
            if own is None:
                own = r.name
                firsts.append((r.name, r.x, r.y))
            out.append((r.name, own))
        return pd.DataFrame(out, columns=["name", "spelling"])

    return names.select("block", "name", "x", "y").groupBy("block").applyInPandas(run, "name string, spelling string")


def propagate_anchors(unknown: DataFrame, links: DataFrame, known: DataFrame, rounds: int = 5) -> DataFrame:
    """``(name, x, y, round)``: places without a position take the mean of their placed neighbours, round by round. (RES-08)

    Rounds are synchronous: a round sees only what earlier rounds placed, so row order does not matter.
    """
    placed = known.select("name", "x", "y", F.lit(0).alias("round"))
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    for k in range(1, rounds + 1):
        todo = unknown.join(placed.select("name"), "name", "left_anti")
        near = todo.join(both, todo["name"] == both["a"]).join(placed.select(F.col("name").alias("pn"), "x", "y"), F.col("b") == F.col("pn"))
        new = near.groupBy("name").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("round", F.lit(k))
        placed = materialised(placed.union(new))
    return placed.where("round > 0")


def open_tour(stops: DataFrame, group: str, job_share: float = 0.3, gain: float = 1.0) -> DataFrame:
    """``(group, name, place)``: an open tour from the first stop: nearest neighbour, then 2-opt, by name on ties. (OPT-01)

    ``stops(group, name, x, y, job)``: consecutive stops with the same job number cost only ``job_share`` of their distance.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("name").reset_index(drop=True)
        xy, job = g[["x", "y"]].to_numpy(), g["job"].tolist()

        def cost(i: int, j: int) -> float:
            d = math.hypot(*(xy[i] - xy[j]))
            return d * job_share if job[i] == job[j] and job[i] is not None and job[i] == job[i] else d

        tour, rest = [0], list(range(1, len(g)))
        while rest:
            nxt = min(rest, key=lambda j: (cost(tour[-1], j), j))
            tour.append(nxt)
            rest.remove(nxt)
        better = True
        while better:
            better = False
            for i in range(1, len(tour) - 1):
                for j in range(i + 1, len(tour)):
                    old = cost(tour[i - 1], tour[i]) + (cost(tour[j], tour[j + 1]) if j + 1 < len(tour) else 0)
                    new = cost(tour[i - 1], tour[j]) + (cost(tour[i], tour[j + 1]) if j + 1 < len(tour) else 0)
                    if old - new > gain:
                        tour[i : j + 1] = tour[i : j + 1][::-1]
                        better = True
        return pd.DataFrame({group: g[group].iloc[0], "name": g["name"].iloc[tour].to_numpy(), "place": range(len(tour))})

    kind = dict(stops.dtypes)[group]
    return stops.select(group, "name", "x", "y", "job").groupBy(group).applyInPandas(run, f"{group} {kind}, name string, place long")


def added_text(old: str | None, new: str | None) -> str:
    """The words that ``new`` has beyond ``old``, in order. (STR-15)"""
    a, b = (old or "").split(), (new or "").split()
    return " ".join(w for op, _, _, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op in ("insert", "replace") for w in b[j1:j2])


def affine_fit(points: DataFrame, rounds: int = 4, sigmas: float = 3.0, floor: float = 3.0) -> tuple[tuple[float, float, float], float, int]:
    """Least-squares ``v = a + b x + c y`` with outliers beyond ``sigmas`` standard deviations dropped, up to ``rounds`` times. (MTH-04)

    Each round is one aggregate of nine sums; the 3 x 3 system is solved on the driver. Returns the coefficients, the rms and the rows used.
    """
    import numpy as np

    left = points.select(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "v"))).dropna()
    for turn in range(rounds + 1):
        s = left.agg(*(F.sum(e).alias(n) for n, e in (("n", F.lit(1.0)), ("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y")), ("v", F.col("v")), ("xv", F.col("x") * F.col("v")), ("yv", F.col("y") * F.col("v"))))).first()
        a, b, c = np.linalg.solve([[s["n"], s["x"], s["y"]], [s["x"], s["xx"], s["xy"]], [s["y"], s["xy"], s["yy"]]], [s["v"], s["xv"], s["yv"]])
        off = F.col("v") - (F.lit(float(a)) + F.lit(float(b)) * F.col("x") + F.lit(float(c)) * F.col("y"))
        rms = left.agg(F.sqrt(F.avg(off * off))).first()[0]
        limit = max(floor, sigmas * rms)
        kept = left.where(F.abs(off) <= limit)
        n = kept.count()
        if turn == rounds or n == s["n"]:
            return (float(a), float(b), float(c)), float(rms), int(s["n"])
        left = kept
    raise AssertionError


def sample_grid(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float, cols: int, rows: int) -> DataFrame:
    """``points`` with ``z`` of the nearest cell of ``cells(row, col, z)``; outside points take the border cell. (RAS-01)"""
    col = F.least(F.lit(cols - 1), F.greatest(F.lit(0), F.floor((F.col("x") - x0) / dx))).cast("int")
    row = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor((y0 - F.col("y")) / dy))).cast("int")
    return points.withColumns({"col": col, "row": row}).join(cells, ["row", "col"], "left").drop("row", "col")
