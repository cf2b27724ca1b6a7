"""Queries on positions and networks: distance joins, clusters, polygons, paths, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import access, graph, spatial
from waymark.plans.base import EVM, SUP, event_metres, read, supplier_points

RADIUS = 300.0
#: An L-shaped village outline and a triangle, in file order; the first that contains a point owns it.
OUTLINES = {
    "L-shape": [(2000.0, 2000.0), (9000.0, 2000.0), (9000.0, 5000.0), (5000.0, 5000.0), (5000.0, 11000.0), (2000.0, 11000.0)],
    "triangle": [(7000.0, 4000.0), (17000.5, 6000.0), (12000.0, 18000.0)],
}
SEEDS = [(i, float(i * 4001 % 20011), float(i * 9001 % 20011)) for i in range(1, 12)]


def nearest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's nearest supplier within 1500 m, ties all kept. (JOI-06)"""
    out = spatial.nearest_within(event_metres(spark, sf_dir), supplier_points(spark, sf_dir), "event_id", "s_suppkey", ("x", "y"), ("x", "y"), 1500.0)
    return out.select("event_id", "s_suppkey", F.bround("d", 4).alias("d"))


def nearest_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within 600 m, the least key on a tie. (JOI-07)"""
    out = spatial.nearest_within(event_metres(spark, sf_dir), supplier_points(spark, sf_dir), "event_id", "s_suppkey", ("x", "y"), ("x", "y"), 600.0, ties=False)
    return out.select("event_id", "s_suppkey", F.bround("d", 4).alias("d"))


def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers within 1500 m. (JOI-09, JOI-10)"""
    return spatial.radius_pairs(supplier_points(spark, sf_dir), "s_suppkey", "x", "y", 1500.0).select("a", "b", F.bround("d", 4).alias("d"))


def coincident_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of different types inside a box of 250 m. (JOI-11)"""
    return spatial.box_pairs(event_metres(spark, sf_dir), "event_id", "event_type", "x", "y", 250.0)


def radius_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage clusters of suppliers at 1500 m, named by their least member. (RES-01, GRA-03)"""
    pts = supplier_points(spark, sf_dir)
    labels = spatial.radius_clusters(pts, "s_suppkey", "x", "y", 1500.0)
    return pts.join(labels, pts["s_suppkey"] == labels["node"], "left").select("s_suppkey", F.coalesce("component", "s_suppkey").alias("cluster"))


def cluster_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's most voted name with its share; ties go to the name seen first. (AGG-05)"""
    e = event_metres(spark, sf_dir).select(F.floor(F.col("x") / 2000).alias("cx"), F.floor(F.col("y") / 2000).alias("cy"), "user_id", "event_type", "event_id")
    votes = e.groupBy("cx", "cy", "user_id", "event_type").agg(F.min("event_id").alias("first")).groupBy("cx", "cy", "event_type").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    best = votes.groupBy("cx", "cy").agg(F.min(F.struct(-F.col("n"), "first", "event_type")).alias("b"), F.sum("n").alias("all_votes"), F.max("n").alias("n"))
    return best.select("cx", "cy", F.col("b.event_type").alias("name"), "n", F.bround(F.col("n") / F.col("all_votes"), 6).alias("share"))


def conflict_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that claim one name: the best by (votes, agreeing, id) keeps it, the others are disputed. (WIN-07)"""
    v = cluster_vote(spark, sf_dir)
    w = spatial.Window.partitionBy("name").orderBy(F.desc("n"), F.desc("share"), "cx", "cy")
    return v.select("cx", "cy", "name", F.row_number().over(w).alias("place"), (F.row_number().over(w) > 1).alias("disputed"))


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road graph on nations: a ring of regions, spokes and some cross roads."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    ring = n.select(F.col("k").alias("src"), ((F.col("k") + 1) % 25).alias("dst"), (F.col("k") * 7 % 11 + 1).cast("double").alias("weight")).where("src % 5 <> 4")
    spoke = n.select(F.col("k").alias("src"), (F.col("k") * 3 % 25).alias("dst"), (F.col("k") * 5 % 13 + 2).cast("double").alias("weight")).where("src % 2 = 0")
    return ring.union(spoke)


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path weights from two stops. (GRA-04, GRA-05)"""
    stops = read(spark, sf_dir, "nation").where("n_nationkey in (0, 12)").select(F.col("n_nationkey").cast("long").alias("source"))
    return graph.shortest_paths(road_edges(spark, sf_dir), stops).select("source", "node", "km")


def nearest_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's nearest stop by road, the first on a tie, and its class. (GRA-06, FIL-05)"""
    paths = shortest_paths(spark, sf_dir)
    best = paths.groupBy("node").agg(F.min(F.struct("km", "source")).alias("b"))
    return best.select("node", F.col("b.source").alias("stop"), F.col("b.km").alias("km"), geo.access_class(F.col("b.km") * 1000).alias("access"))


def service_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within each band of a stop. (GEO-19, AGG-10)"""
    paths = shortest_paths(spark, sf_dir)
    bands = F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))
    return paths.select("source", "node", "km", bands.alias("band")).where("km <= band").groupBy("source", "band").agg(F.count("*").alias("nodes"), F.max("km").alias("furthest"))


def mst_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges up to 4500 m between the loose ends of chains of five suppliers: their number and total. (GRA-02)"""
    pts = supplier_points(spark, sf_dir).select(F.col("s_suppkey").cast("long").alias("node"), "x", "y")
    chains = pts.where("node % 5 <> 0").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    bridges = access.bridge_gaps(chains.join(pts.select(F.col("node").alias("dst")), "dst", "left_semi"), pts, 4500.0)
    return bridges.agg(F.count("*").alias("edges"), F.bround(F.sum("weight"), 4).alias("metres"))


def road_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access table of suppliers as villages on the road graph of nations, as delivered and with all stops upgraded. (JOI-08, GRA-07, FIL-06, FIL-24, GRA-10)"""
    villages = supplier_points(spark, sf_dir).select(F.col("s_suppkey").alias("village"), "x", "y", (F.col("s_suppkey") % 7 == 0).alias("foot_only"))
    k = F.col("n_nationkey").cast("long")
    nodes = read(spark, sf_dir, "nation").select(k.alias("node"), (k * 3001 % 20011).cast("double").alias("x"), (k * 7001 % 20011).cast("double").alias("y"))
    stops = nodes.where("node in (0, 5, 12, 18)").select(F.col("node").alias("stop"), (F.col("x") + F.col("node") * 130).alias("x"), "y", (F.col("node") % 5 == 0).alias("track_only"))
    return access.access_tables(villages, nodes, road_edges(spark, sf_dir), stops, (False, True)).drop("walk_hours_back")


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node degrees of the road graph without loops and double edges. (GRA-01, GRA-09)"""
    e = graph.undirected(road_edges(spark, sf_dir))
    return e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.min("weight").alias("least"))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first outline in file order that contains each event. (JOI-12, GEO-05)"""
    e = event_metres(spark, sf_dir)
    owner = F.coalesce(*(F.when(geo.in_ring(F.col("x") + 0.25, F.col("y") + 0.25, ring), name) for name, ring in OUTLINES.items()))
    return e.select("event_id", owner.alias("outline")).where("outline is not null")


def nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest outline edge, and whose it is. (JOI-13, GEO-06)"""
    e = event_metres(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    gaps = {n: F.least(*(geo.segment_distance(x, y, *a, *b) for a, b in zip(r, r[1:] + r[:1], strict=True))) for n, r in OUTLINES.items()}
    a, b = gaps["L-shape"], gaps["triangle"]
    return e.select("event_id", F.bround(F.least(a, b), 3).alias("d"), F.when(a <= b, "L-shape").otherwise("triangle").alias("outline"))


def voronoi_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed whose Voronoi cell holds each event. (GEO-16)"""
    return event_metres(spark, sf_dir).select("event_id", spatial.assign_seeds(None, SEEDS, "x", "y").alias("seed"))


def zone_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and balances by zone, with the share of approximate positions. (AGG-11, AGG-12)"""
    s = supplier_points(spark, sf_dir).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    out = s.groupBy(spatial.assign_seeds(None, SEEDS, "x", "y").alias("seed")).agg(F.count("*").alias("n"), F.bround(F.sum("s_acctbal"), 2).alias("total"), F.bround(F.count_if(F.col("s_suppkey") % 3 == 0) * 100 / F.count("*"), 0).alias("pct_approx"))
    return out


def ring_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins that share an anchor, spread on a ring of 300 m by sorted name. (WIN-14)"""
    s = read(spark, sf_dir, "supplier")
    w = spatial.Window.partitionBy("s_nationkey").orderBy("s_name", "s_suppkey")
    k = s.select("s_suppkey", "s_nationkey", (F.row_number().over(w) - 1).alias("k"), F.count("*").over(spatial.Window.partitionBy("s_nationkey")).alias("n"))
    angle = 2 * F.pi() * F.col("k") / F.col("n")
    return k.select("s_suppkey", "k", (F.bround(300 * F.cos(angle), 4) + 0.0).alias("dx"), (F.bround(300 * F.sin(angle), 4) + 0.0).alias("dy"))


def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and vertices of a quadrilateral for each part, by the shoelace. (GEO-03, GEO-04)"""
    p = read(spark, sf_dir, "part")
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.lit(0.0)), (s, F.lit(0.0)), (s + 1, r), (F.lit(0.0), r))))
    return p.select("p_partkey", F.bround(geo.shoelace(ring), 3).alias("area"), F.size(ring).alias("vertices"))


QUERIES = {
    f.__name__: f
    for f in (
        nearest_ties, nearest_capped, radius_pairs, coincident_box, radius_clusters, cluster_vote, conflict_rank, shortest_paths, nearest_stop, service_bands, mst_bridge, road_access, degrees,
        point_in_polygon, nearest_edge, voronoi_assign, zone_populations, ring_spread, polygon_areas,
    )
}

_NEAR = f"{EVM}, {SUP}, c AS (SELECT event_id, s_suppkey, sqrt(pow(sup.x - evm.x, 2) + pow(sup.y - evm.y, 2)) AS d FROM evm JOIN sup ON abs(sup.x - evm.x) <= {{0}} AND abs(sup.y - evm.y) <= {{0}}), r AS (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY d) AS rk, row_number() OVER (PARTITION BY event_id ORDER BY d, s_suppkey) AS rn FROM c WHERE d <= {{0}})"
_PAIRS = f"{SUP}, p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS d FROM sup a JOIN sup b ON a.s_suppkey < b.s_suppkey)"
_VOTE = f"""{EVM}, u AS (SELECT CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy, user_id, event_type, min(event_id) AS f FROM evm GROUP BY 1, 2, 3, 4),
v AS (SELECT cx, cy, event_type, count(*) AS n, min(f) AS f FROM u GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, f, event_type) AS rn, sum(n) OVER (PARTITION BY cx, cy) AS all_votes FROM v),
b AS (SELECT cx, cy, event_type AS name, n, round_even(n / all_votes, 6) AS share FROM r WHERE rn = 1)"""
_ROADS = """n AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation), e0 AS (SELECT k AS src, (k + 1) % 25 AS dst, CAST(k * 7 % 11 + 1 AS DOUBLE) AS w FROM n WHERE k % 5 <> 4 UNION ALL SELECT k, k * 3 % 25, CAST(k * 5 % 13 + 2 AS DOUBLE) FROM n WHERE k % 2 = 0),
e1 AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(w) AS w FROM e0 WHERE src <> dst GROUP BY 1, 2), arcs AS (SELECT src, dst, w FROM e1 UNION ALL SELECT dst, src, w FROM e1)"""
_PATHS = f"""WITH RECURSIVE {_ROADS}, walk AS (SELECT k AS source, k AS node, CAST(0 AS DOUBLE) AS km, 0 AS hops FROM n WHERE k IN (0, 12) UNION SELECT source, dst, min(km + w), hops + 1 FROM walk JOIN arcs ON src = node WHERE hops < 24 GROUP BY source, dst, hops),
paths AS (SELECT source, node, min(km) AS km FROM walk GROUP BY 1, 2)"""


def _inside(ring: list[tuple[float, float]]) -> str:
    return "(" + " + ".join(f"CASE WHEN ({y1} > py) <> ({y2} > py) AND px < ({x2} - {x1}) * (py - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if y1 != y2) + ") % 2 = 1"


def _edge(ring: list[tuple[float, float]]) -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        t = f"greatest(0.0, least(1.0, ((x - {x1}) * {x2 - x1} + (y - {y1}) * {y2 - y1}) / {(x2 - x1) ** 2 + (y2 - y1) ** 2}))"
        out.append(f"sqrt(pow(x - ({x1} + {t} * {x2 - x1}), 2) + pow(y - ({y1} + {t} * {y2 - y1}), 2))")
    return f"least({', '.join(out)})"


_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}, {y})" for i, x, y in SEEDS) + ") AS t(seed, sx, sy))"

ORACLES = {
    "nearest_ties": f"WITH {_NEAR.format(1500)} SELECT event_id, s_suppkey, round_even(d, 4) AS d FROM r WHERE rk = 1",
    "nearest_capped": f"WITH {_NEAR.format(600)} SELECT event_id, s_suppkey, round_even(d, 4) AS d FROM r WHERE rn = 1",
    "radius_pairs": f"WITH {_PAIRS} SELECT a, b, round_even(d, 4) AS d FROM p WHERE d <= 1500",
    "coincident_box": f"WITH {EVM} SELECT a.event_id AS a, b.event_id AS b FROM evm a JOIN evm b ON a.event_id < b.event_id AND abs(a.x - b.x) < 250 AND abs(a.y - b.y) < 250 WHERE a.event_type <> b.event_type",
    "radius_clusters": f"WITH RECURSIVE {_PAIRS}, l AS (SELECT a, b FROM p WHERE d <= 1500 UNION SELECT b, a FROM p WHERE d <= 1500), w AS (SELECT s_suppkey AS s, s_suppkey AS t FROM sup UNION SELECT w.s, l.b FROM w JOIN l ON l.a = w.t) SELECT s AS s_suppkey, min(t) AS cluster FROM w GROUP BY s",
    "cluster_vote": f"WITH {_VOTE} SELECT * FROM b",
    "conflict_rank": f"WITH {_VOTE} SELECT cx, cy, name, CAST(row_number() OVER (PARTITION BY name ORDER BY n DESC, share DESC, cx, cy) AS INT) AS place, row_number() OVER (PARTITION BY name ORDER BY n DESC, share DESC, cx, cy) > 1 AS disputed FROM b",
    "shortest_paths": f"{_PATHS} SELECT source, node, km FROM paths",
    "nearest_stop": f"{_PATHS} SELECT node, arg_min(source, km * 1000 + source) AS stop, min(km) AS km, CASE WHEN min(km) <= 2.5 THEN 'near' WHEN min(km) <= 10 THEN 'long walk' ELSE 'beyond' END AS access FROM paths GROUP BY node",
    "service_bands": f"{_PATHS} SELECT source, band, count(*) AS nodes, max(km) AS furthest FROM paths, (VALUES (5), (10), (20)) AS b(band) WHERE km <= band GROUP BY 1, 2",
    "road_access": f"""WITH RECURSIVE {SUP}, {_ROADS}, far AS (SELECT k AS source, k AS node, CAST(0 AS DOUBLE) AS km, 0 AS hops FROM n UNION SELECT source, dst, min(km + w), hops + 1 FROM far JOIN arcs ON src = node WHERE hops < 24 GROUP BY source, dst, hops),
ways AS (SELECT source, node, min(km) AS km FROM far GROUP BY 1, 2), nd AS (SELECT k, CAST(k * 3001 % 20011 AS DOUBLE) AS x, CAST(k * 7001 % 20011 AS DOUBLE) AS y FROM n),
stp AS (SELECT k AS stop, x + k * 130 AS x, y, k % 5 = 0 AS track FROM nd WHERE k IN (0, 5, 12, 18)), sn AS (SELECT * FROM (SELECT stop, stp.x, stp.y, track, nd.k AS node, sqrt(pow(nd.x - stp.x, 2) + pow(nd.y - stp.y, 2)) AS off, row_number() OVER (PARTITION BY stop ORDER BY sqrt(pow(nd.x - stp.x, 2) + pow(nd.y - stp.y, 2)), nd.k) AS rn FROM stp, nd) WHERE rn = 1),
vn AS (SELECT * FROM (SELECT s_suppkey AS village, sup.x, sup.y, nd.k AS node, sqrt(pow(nd.x - sup.x, 2) + pow(nd.y - sup.y, 2)) AS off, row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt(pow(nd.x - sup.x, 2) + pow(nd.y - sup.y, 2)), nd.k) AS rn FROM sup, nd) WHERE rn = 1),
cand AS (SELECT village, vn.x, vn.y, vn.node, vn.off, upgraded, stop, sn.off AS soff, track AND NOT upgraded AS track, ways.km, sqrt(pow(sn.x - vn.x, 2) + pow(sn.y - vn.y, 2)) AS m, vn.off <= 2500 AND km IS NOT NULL AND NOT (track AND NOT upgraded) AS by_road FROM vn CROSS JOIN sn CROSS JOIN (VALUES (false), (true)) AS up(upgraded) LEFT JOIN ways ON ways.source = sn.node AND ways.node = vn.node),
one AS (SELECT *, off <= 2000 AND soff <= 2000 AND km IS NOT NULL AS walks, row_number() OVER (PARTITION BY village, upgraded ORDER BY by_road DESC, CASE WHEN by_road THEN km ELSE m END, stop) AS rn FROM cand)
SELECT village, upgraded, stop AS nearest_stop, CASE WHEN by_road THEN round_even(km, 2) END AS road_km, round_even(m / 1000, 2) AS straight_km, round_even(CASE WHEN walks THEN km + (CASE WHEN off > 1 THEN off ELSE 0 END + CASE WHEN soff > 1 THEN soff ELSE 0 END) / 1000 ELSE m / 1000 END / (6 * exp(-0.175)), 2) AS walk_hours, CASE WHEN off <= 2500 THEN 'yes' ELSE 'no' END AS road_reachable,
CASE WHEN off <= 2500 THEN 'near' WHEN off <= 10000 THEN 'long walk' ELSE 'beyond' END AS access, CASE WHEN village % 7 = 0 THEN 'no (field knowledge)' WHEN off <= 100 THEN 'yes' ELSE 'no (measured)' END AS road_at_village, round_even(off, 0) AS off_m, CASE WHEN walks THEN 'path network' ELSE 'straight line' END AS walk_basis, CASE WHEN track THEN 'track only' ELSE 'road' END AS stop_access FROM one WHERE rn = 1""",
    "degrees": f"WITH {_ROADS} SELECT src AS node, count(*) AS degree, min(w) AS least FROM arcs GROUP BY 1",
    "point_in_polygon": f"WITH {EVM}, q AS (SELECT event_id, x + 0.25 AS px, y + 0.25 AS py FROM evm), o AS (SELECT event_id, CASE WHEN {_inside(OUTLINES['L-shape'])} THEN 'L-shape' WHEN {_inside(OUTLINES['triangle'])} THEN 'triangle' END AS outline FROM q) SELECT * FROM o WHERE outline IS NOT NULL",
    "nearest_edge": f"WITH {EVM}, g AS (SELECT event_id, {_edge(OUTLINES['L-shape'])} AS a, {_edge(OUTLINES['triangle'])} AS b FROM evm) SELECT event_id, round_even(least(a, b), 3) AS d, CASE WHEN a <= b THEN 'L-shape' ELSE 'triangle' END AS outline FROM g",
    "voronoi_assign": f"WITH {EVM}, {_SEEDS}, r AS (SELECT event_id, seed, row_number() OVER (PARTITION BY event_id ORDER BY sqrt(pow(x - sx, 2) + pow(y - sy, 2)), seed) AS rn FROM evm, seeds) SELECT event_id, seed FROM r WHERE rn = 1",
    "zone_populations": f"WITH {SUP}, {_SEEDS}, r AS (SELECT s_suppkey, seed, row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt(pow(x - sx, 2) + pow(y - sy, 2)), seed) AS rn FROM sup, seeds) SELECT seed, count(*) AS n, round_even(sum(s_acctbal), 2) AS total, round_even(count(*) FILTER (WHERE s_suppkey % 3 = 0) * 100 / count(*), 0) AS pct_approx FROM r JOIN supplier USING (s_suppkey) WHERE rn = 1 GROUP BY 1",
    "ring_spread": "WITH k AS (SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1 AS INT) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_suppkey, k, round_even(300 * cos(2 * pi() * k / n), 4) + 0e0 AS dx, round_even(300 * sin(2 * pi() * k / n), 4) + 0e0 AS dy FROM k",
    "polygon_areas": "SELECT p_partkey, round_even(abs((0.0 * 0.0 - p_size * 0.0) + (p_size * p_retailprice - (p_size + 1) * 0.0) + ((p_size + 1) * p_retailprice - 0.0 * p_retailprice) + (0.0 * 0.0 - 0.0 * p_retailprice)) / 2, 3) AS area, 4 AS vertices FROM part",
}
