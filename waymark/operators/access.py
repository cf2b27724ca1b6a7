"""Road access of places: snapping without a cap, bridges between loose ends, the access table. (JOI-08, GRA-02, GRA-06, GRA-07, FIL-06, FIL-24, GRA-10)"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import graph, linear, spatial
from waymark.operators.graph import materialised
from waymark.operators.spatial import finite

#: Metres up to which a place is routed by road, and up to which a walk takes the path network.
ROUTE_SNAP_M, WALK_SNAP_M = 2500.0, 2000.0
#: A place at most this far from the road has it in the village.
AT_ROAD_M = 100.0


def nearest_any(left: DataFrame, right: DataFrame, lkey: str, rkey: str, first: float | None = None) -> DataFrame:
    """``(lkey, rkey, d)``: the nearest row of ``right(rkey, x, y)`` for every row of ``left(lkey, x, y)``, at any distance, the
    least key on a tie. (JOI-08)

    A round looks within a reach, at first about the right side's spacing; rows without a partner go on with four times the reach, so there
    are as many rounds as the logarithm of the longest distance. Rows without a finite place have no nearest one; an empty right
    side gives no rows.
    """
    rest = finite(left.select(lkey, "x", "y"))
    right = materialised(finite(right.select(rkey, "x", "y")).select(rkey, F.col("x").alias("rx"), F.col("y").alias("ry")))
    n, wide, high = right.agg(F.count("*"), F.max("rx") - F.min("rx"), F.max("ry") - F.min("ry")).first()
    if not n:
        return rest.select(lkey, F.lit(None).cast(dict(right.dtypes)[rkey]).alias(rkey), F.lit(0.0).alias("d")).where("false")
    found, reach = None, first or max(math.sqrt(wide * high / n), (wide + high) / n, 1.0)
    while True:
        near = materialised(spatial.nearest_in(rest, right, lkey, rkey, ("x", "y"), ("rx", "ry"), reach, ties=False))
        found = near if found is None else found.unionByName(near)
        rest = materialised(rest.join(near, lkey, "left_anti"))
        if rest.isEmpty():
            return found
        reach *= 4


def bridge_gaps(edges: DataFrame, nodes: DataFrame, gap: float = 450.0) -> DataFrame:
    """``(a, b, weight)``: the bridges between nodes of degree one in different components of ``edges(src, dst, weight)``, with
    ``nodes(node, x, y)``: shortest first, each only if it still joins two components. (GRA-02)

    That is the least spanning forest of the components over their closest pairs of ends, grown in rounds of a reach that goes fourfold up to
    ``gap``: what a round has joined does not meet again, so the pairs of a dense set of ends are never all made. Of ends at one place only the least
    component's meets the others, which come after it in the order of bridges.
    """
    both = graph.undirected(edges)
    parts = materialised(graph.connected_components(edges).select("node", F.col("component").alias("own")))
    ends = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).where("degree = 1").join(nodes, "node")
    ends = materialised(spatial.finite(ends.join(parts, "node").select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "own")))
    labels = parts.select(F.col("own").alias("node"), F.col("own").alias("component")).distinct()
    least = ends.groupBy("x", "y").agg(F.min("own").alias("least"))
    firsts = ends.join(least, ["x", "y"]).where("own = least").select("x", "y", F.col("node").alias("first"), "least")
    pairs = ends.join(firsts, ["x", "y"]).where("own <> least").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"), F.lit(0.0).alias("d"))
    found, reach, wider = None, 0.0, 2 * spatial.spacing(ends.select("x", "y").distinct(), "x", "y") or gap
    while True:
        a, b = ends.select(F.col("node").alias("a"), F.col("own").alias("ca")), ends.select(F.col("node").alias("b"), F.col("own").alias("cb"))
        across = pairs.join(a, "a").join(b, "b").select(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst"), F.col("d").alias("weight"), "a", "b")
        across = materialised(across.groupBy("src", "dst").agg(F.min(F.struct("weight", "a", "b")).alias("m")).select("src", "dst", "m.weight", "m.a", "m.b"))
        forest, labels = graph.grown_forest(across.select("src", "dst", "weight"), labels)
        took = materialised(across.join(forest.select("src", "dst"), ["src", "dst"]).select("a", "b", "weight"))
        found = took if found is None else found.unionByName(took)
        now = ends.join(labels.withColumnRenamed("node", "own"), "own").select("node", "x", "y", "component")
        if reach >= gap or now.select("component").distinct().limit(2).count() < 2:
            return found
        reach, wider = min(wider, gap), 4 * wider
        pairs = spatial.cross_pairs(materialised(now), reach)


def walking_hours(metres: Column) -> Column:
    """Hours on level ground by Tobler's rule; the climb is not in it."""
    return metres / 1000 / geo.tobler_kmh(F.lit(0.0))


@dataclass(frozen=True)
class Ground:
    """Elevations as ``cells(row, col, z)`` of a grid (left, top, cell size, rows, columns)."""

    cells: DataFrame
    grid: tuple[float, float, float, int, int]

    def hours(self, lines: DataFrame) -> DataFrame:
        """``(line_id, hours, hours_back)`` of ``lines(line_id, seq, x, y)`` walked in their order and against it."""
        both = lines.select("line_id", "seq", "x", "y").withColumn("line_id", F.struct(F.lit(False).alias("back"), "line_id"))
        back = lines.select(F.struct(F.lit(True).alias("back"), "line_id").alias("line_id"), (-F.col("seq")).alias("seq"), "x", "y")
        t = linear.walking_hours(both.unionByName(back), self.cells, self.grid).select(F.col("line_id.line_id").alias("line_id"), F.col("line_id.back").alias("back"), "hours")
        return t.groupBy("line_id").agg(F.max(F.when(~F.col("back"), F.col("hours"))).alias("hours"), F.max(F.when(F.col("back"), F.col("hours"))).alias("hours_back"))


@dataclass(frozen=True)
class Snapped:
    """Where villages ``at(village, node, off)`` and stops ``stops(stop, sx, sy, source, stop_off)`` meet a network, and the distances ``km(source, node, km)`` on it."""

    at: DataFrame
    stops: DataFrame
    km: DataFrame

    @staticmethod
    def of(villages: DataFrame, nodes: DataFrame, edges: DataFrame, stops: DataFrame) -> Snapped:
        at = materialised(nearest_any(villages, nodes, "village", "node").select("village", "node", F.col("d").alias("off")))
        stop_at = nearest_any(stops, nodes, "stop", "node").select("stop", F.col("node").alias("source"), F.col("d").alias("stop_off"))
        known = materialised(stops.select("stop", F.col("x").alias("sx"), F.col("y").alias("sy")).join(stop_at, "stop"))
        return Snapped(at, known, graph.shortest_paths(edges, known.select("source").distinct()))


def walks(trips: DataFrame, nodes: DataFrame, edges: DataFrame, on: Snapped, ground: Ground | None = None) -> DataFrame:
    """``(village, stop, basis, metres, hours, hours_back)`` of each of ``trips(village, x, y, stop)``, over the paths ``edges`` between ``nodes``. (GRA-05, GRA-07)

    Villages and stops go to their nearest path node. Where both are up to 2,000 m off and connected the walk is the path, with the straight hops of over a metre at
    both ends; else it is the straight line. With ``ground`` the hours follow the climb, so that they differ by direction; without, the ground is level.
    """
    rows = trips.select("village", "x", "y", "stop").join(on.at, "village").join(on.stops, "stop").join(on.km, ["source", "node"], "left")
    near = (F.col("off") <= WALK_SNAP_M) & (F.col("stop_off") <= WALK_SNAP_M) & F.col("km").isNotNull()
    rows = materialised(rows.withColumn("by_path", near))
    hop = lambda c: F.when(F.col(c) > 1, F.col(c)).otherwise(0.0)
    straight = F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    metres = F.when(F.col("by_path"), F.col("km") * 1000 + hop("off") + hop("stop_off")).otherwise(straight)
    basis = F.when(F.col("by_path"), "path network").otherwise("straight line")
    if ground is None:
        return rows.select("village", "stop", basis.alias("basis"), metres.alias("metres"), walking_hours(metres).alias("hours"), walking_hours(metres).alias("hours_back"))
    place = nodes.select(F.col("node").alias("at"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    trees = graph.path_trees(edges, on.km)
    path = graph.unrolled(trees, rows.where("by_path").select("source", "node"))
    way = path.join(place, "at").select(F.struct(F.lit("path").alias("part"), F.to_json(F.struct("source")).alias("a"), F.to_json(F.struct("node")).alias("b")).alias("line_id"), F.col("pos").alias("seq"), F.col("nx").alias("x"), F.col("ny").alias("y"))
    ends = rows.join(place.select(F.col("at").alias("node"), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("pn")), "node").join(place.select(F.col("at").alias("source"), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("pt")), "source")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    leg = lambda part, a, b: F.struct(F.lit(part).alias("part"), F.array(a, b).alias("points"))
    here, there, first, last = point("x", "y"), point("sx", "sy"), point("pn.x", "pn.y"), point("pt.x", "pt.y")
    legs = F.array_compact(F.array(F.when(F.col("by_path") & (F.col("off") > 1), leg("start", here, first)), F.when(F.col("by_path") & (F.col("stop_off") > 1), leg("end", last, there)), F.when(~F.col("by_path"), leg("straight", here, there))))
    hops = ends.select("village", "stop", F.explode(legs).alias("leg")).select("village", "stop", "leg.part", F.posexplode("leg.points").alias("seq", "p"))
    hops = hops.select(F.struct("part", F.to_json(F.struct("village")).alias("a"), F.to_json(F.struct("stop")).alias("b")).alias("line_id"), F.col("seq").cast("long").alias("seq"), "p.x", "p.y")
    took = materialised(ground.hours(way.unionByName(hops)).select("line_id.*", "hours", "hours_back"))
    on_path = took.where("part = 'path'").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("hours").alias("path_hours"), F.col("hours_back").alias("path_back"))
    on_legs = took.where("part <> 'path'").groupBy(F.col("a").alias("va"), F.col("b").alias("vb")).agg(F.sum("hours").alias("leg_hours"), F.sum("hours_back").alias("leg_back"))
    key = lambda c: F.to_json(F.struct(c))
    out = rows.join(on_path, F.col("by_path") & (key("source") == F.col("pa")) & (key("node") == F.col("pb")), "left").join(on_legs, (key("village") == F.col("va")) & (key("stop") == F.col("vb")), "left")
    total = lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    return out.select("village", "stop", basis.alias("basis"), metres.alias("metres"), total("path_hours", "leg_hours").alias("hours"), total("path_back", "leg_back").alias("hours_back"))


def access_tables(
    villages: DataFrame, nodes: DataFrame, edges: DataFrame, stops: DataFrame, scenarios: tuple[bool, ...] = (False,),
    walk_nodes: DataFrame | None = None, walk_edges: DataFrame | None = None, ground: Ground | None = None,
) -> DataFrame:
    """The access table, once for each scenario (column ``upgraded``): for each of ``villages(village, x, y, foot_only)`` its stop of ``stops(stop, x, y, track_only)``,
    by the roads ``edges(src, dst, weight)`` in km between ``nodes(node, x, y)``. (GRA-10)

    A place up to 2,500 m from its nearest node takes the stop that is nearest by road, the least stop on a tie; stops that no vehicle
    reaches serve nobody by road, unless ``upgraded``. Other places, and those that no served stop reaches, take the stop nearest in a
    straight line. The walk to that stop is that of :func:`walks` over ``walk_nodes`` and ``walk_edges``, by default (or if one of them is missing) the roads. Field knowledge that a village
    is on foot only outranks the distance. Places that are not finite are left out; a network without nodes, or no stops, gives an empty table.

    Snaps, distances and walks are computed once for all scenarios.
    """
    villages = finite(villages)
    road = Snapped.of(villages, nodes, edges, stops)
    track = stops.select("stop", F.coalesce("track_only", F.lit(False)).alias("track_only"))
    known = materialised(road.stops.join(track, "stop"))
    served = materialised(road.at.where(F.col("off") <= ROUTE_SNAP_M).join(road.km, "node").join(known.select("stop", "source", "track_only"), "source"))
    straight = nearest_any(villages, stops, "village", "stop").select("village", F.col("stop").alias("straight_stop"))
    wanted = None
    for upgraded in scenarios:
        open_ = served if upgraded else served.where("not track_only")
        best = open_.groupBy("village").agg(F.min(F.struct("km", "stop")).alias("m")).select("village", F.col("m.stop").alias("road_stop"), F.col("m.km").alias("road_km"), F.lit(upgraded).alias("upgraded"))
        own = villages.select("village", "x", "y", "foot_only", F.lit(upgraded).alias("upgraded")).join(best, ["village", "upgraded"], "left")
        wanted = own if wanted is None else wanted.unionByName(own)
    rows = materialised(wanted.join(road.at, "village").join(straight, "village").withColumn("stop", F.coalesce("road_stop", "straight_stop")).join(known.select("stop", "sx", "sy", "track_only"), "stop"))
    # a village may walk to two stops in two scenarios
    trips = rows.select("village", "x", "y", "stop").distinct()
    if walk_nodes is None or walk_edges is None:
        walk = walks(trips, nodes, edges, road, ground)
    else:
        walk = walks(trips, walk_nodes, walk_edges, Snapped.of(villages, walk_nodes, walk_edges, stops), ground)
    rows = rows.join(walk.select("village", "stop", "basis", "hours", "hours_back"), ["village", "stop"])
    metres = F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    return rows.select(
        "village", "upgraded", F.col("stop").alias("nearest_stop"), F.bround("road_km", 2).alias("road_km"), F.bround(metres / 1000, 2).alias("straight_km"),
        F.bround("hours", 2).alias("walk_hours"), F.bround("hours_back", 2).alias("walk_hours_back"),
        F.when(F.col("off") <= ROUTE_SNAP_M, "yes").otherwise("no").alias("road_reachable"), geo.access_class(F.col("off")).alias("access"),
        F.when(F.coalesce("foot_only", F.lit(False)), "no (field knowledge)").when(F.col("off") <= AT_ROAD_M, "yes").otherwise("no (measured)").alias("road_at_village"),
        F.bround("off", 0).alias("off_m"), F.col("basis").alias("walk_basis"), F.when(F.col("track_only") & ~F.col("upgraded"), "track only").otherwise("road").alias("stop_access"),
    )


def road_access(villages: DataFrame, nodes: DataFrame, edges: DataFrame, stops: DataFrame, upgraded: bool = False, walk_nodes: DataFrame | None = None, walk_edges: DataFrame | None = None, ground: Ground | None = None) -> DataFrame:
    """The access table of one scenario; see :func:`access_tables`."""
    return access_tables(villages, nodes, edges, stops, (upgraded,), walk_nodes, walk_edges, ground).drop("upgraded", "walk_hours_back")
