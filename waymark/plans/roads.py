"""Queries on linear referencing of roads, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import access, evidence, graph, linear
from waymark.operators import trajectory as tr
from waymark.plans.base import EVM, STEPS, SUP, event_metres, read, supplier_points
from waymark.plans.motion import OK, WIDE, stepped


def road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as five roads in metres."""
    p = supplier_points(spark, sf_dir)
    return p.select((F.col("s_suppkey") % 5).alias("line_id"), F.col("s_suppkey").alias("seq"), "x", "y")


def road_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads cut into equal pieces of about 500 m, which keep their vertices: length, vertices, ends and sinuosity. (GEO-08, AGG-04)"""
    pieces = linear.chunked(road_lines(spark, sf_dir))
    at = F.struct("x", "y")
    ends = pieces.groupBy("line_id", "chunk").agg(F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"))
    out = linear.chunk_lengths(pieces).join(ends, ["line_id", "chunk"])
    return out.select("line_id", "chunk", F.bround("metres", 4).alias("metres"), "vertices", *((F.bround(f"{e}.{c}", 3) + 0.0).alias(f"{c}_{e}") for e in "ab" for c in "xy"), F.bround("sinuosity", 6).alias("sinuosity"))


def road_chunk_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds by road piece: each step goes to the piece nearest to it, within 200 m; pieces with at least 8 steps. (GEO-08, JOI-06, AGG-02)"""
    steps = event_metres(spark, sf_dir).select("event_id", "x", "y").join(read(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("kmh")), "event_id")
    near = linear.nearest_piece(steps, "event_id", linear.chunked(road_lines(spark, sf_dir)), 200.0)
    out = near.join(steps.select("event_id", "user_id", "kmh"), "event_id").groupBy("line_id", "chunk").agg(
        F.avg("kmh").alias("mean"), F.percentile("kmh", 0.5).alias("median"), F.percentile("kmh", 0.15).alias("p15"), F.count("*").alias("n"), F.count_distinct("user_id").alias("runs"), F.avg("d").alias("off")
    )
    return out.where("n >= 8").select("line_id", "chunk", *(F.bround(c, 6).alias(c) for c in ("mean", "median", "p15")), "n", "runs", F.bround("off", 4).alias("off"))


def thinned_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each road keeps outside the corridors of longer ones, in pieces of 60 m: lines of two suppliers, longest first. (GEO-13)"""
    p = supplier_points(spark, sf_dir).select(F.floor(F.col("s_suppkey") / 2).alias("line_id"), F.col("s_suppkey").alias("seq"), "x", "y")
    out = linear.thinned(p)
    return out.groupBy("line_id").agg(F.count("*").alias("pieces"), F.bround(F.sum(F.col("m1") - F.col("m0")), 3).alias("kept_m"))


def walk_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths on nations, at other places than the roads' nodes: nodes, and edges by their length in km."""
    k = F.col("n_nationkey").cast("long")
    nodes = read(spark, sf_dir, "nation").select((k + 100).alias("node"), (k * 7001 % 20011).cast("double").alias("x"), (k * 5003 % 20011).cast("double").alias("y"))
    src = nodes.select(F.col("node").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.array((F.col("node") - 99) % 25 + 100, ((F.col("node") - 100) * 7 + 3) % 25 + 100)).alias("dst"))
    ends = src.where("src % 6 <> 0").join(nodes.withColumnRenamed("node", "dst"), "dst")
    return nodes, ends.select("src", "dst", (F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) / 1000).alias("weight"))


def walk_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of suppliers to the nearest of four stops over a path network of its own, with the climb over a grid of parts' heights: hours there and back. (GRA-05, GRA-07, MTH-02, RAS-01)"""
    villages = supplier_points(spark, sf_dir).select(F.col("s_suppkey").alias("village"), "x", "y")
    nodes, edges = walk_network(spark, sf_dir)
    stops = nodes.where("node in (100, 105, 112, 118)").select(F.col("node").alias("stop"), (F.col("x") + F.col("node") * 3).alias("x"), "y")
    cells = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 100).alias("k")).agg((F.avg("p_size") * 8).alias("z"))
    ground = access.Ground(cells.select(F.floor(F.col("k") / 10).cast("int").alias("row"), (F.col("k") % 10).cast("int").alias("col"), "z"), (0.0, 20011.0, 2001.1, 10, 10))
    trips = villages.join(access.nearest_any(villages, stops, "village", "stop").select("village", "stop"), "village")
    out = access.walks(trips, nodes, edges, access.Snapped.of(villages, nodes, edges, stops), ground)
    return out.select("village", "stop", "basis", F.bround("metres", 3).alias("metres"), F.bround("hours", 5).alias("hours"), F.bround("hours_back", 5).alias("hours_back"))


def path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the shortest path from every path node to two stops, in order, with the km left. (GRA-05)"""
    _, edges = walk_network(spark, sf_dir)
    nation = read(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("source")).where("source in (100, 112)")
    trees = graph.path_trees(edges, graph.shortest_paths(edges, nation))
    rows = graph.unrolled(trees, trees.select("source", "node"))
    left = trees.select("source", F.col("node").alias("at"), F.bround("km", 6).alias("km_left"))
    return rows.join(left, ["source", "at"]).select("source", "node", "pos", "at", "km_left")


def mode_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mode for each user's track by all six rungs of evidence; a third of the users have times, and suppliers' lines are the older survey. (FIL-04, GEO-09)"""
    tracks = event_metres(spark, sf_dir).where("user_id % 4 <> 1 or event_id % 3 = 0").select(F.col("user_id").alias("line_id"), F.col("event_id").alias("seq"), (F.col("x") / F.when(F.col("user_id") % 4 == 1, 40).otherwise(9)).alias("x"), (F.col("y") / F.when(F.col("user_id") % 4 == 1, 40).otherwise(9)).alias("y"))
    speeds = tr.run_speeds(stepped(spark, sf_dir).where("user_id % 3 = 0"), "user_id", tr.valid_step(**WIDE)).select(F.col("user_id").alias("line_id"), "mode", "median_kmh", "fast")
    gradients = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("line_id")).agg((F.percentile("value", 0.85) / 25).alias("p85"))
    p = supplier_points(spark, sf_dir)
    survey = p.select((F.col("s_suppkey") % 5).alias("line_id"), F.col("s_suppkey").alias("seq"), (F.col("x") / 12).alias("x"), (F.col("y") / 12).alias("y"), (F.col("s_suppkey") % 5 < 3).alias("motor"))
    return evidence.mode_cascade(tracks, speeds, gradients, survey)


QUERIES = {f.__name__: f for f in (road_chunks, road_chunk_speeds, thinned_roads, walk_access, path_rows, mode_evidence)}

#: Pieces of the five roads: the points of each, with their measures.
_PIECES = f"""{SUP}, ln AS (SELECT s_suppkey % 5 AS line_id, s_suppkey AS seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM sup WINDOW w AS (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey)),
sg AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM ln WHERE x2 IS NOT NULL), up AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seq) - len AS upto, sum(len) OVER (PARTITION BY line_id) AS total FROM sg WHERE len > 0),
wd AS (SELECT line_id, any_value(total) AS total, greatest(CAST(round_even(any_value(total) / 500, 0) AS BIGINT), 1) AS n FROM up GROUP BY 1), ct AS (SELECT line_id, n, k, k * (total / n) AS m FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM wd)),
cp AS (SELECT line_id, n, k, m, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM (SELECT ct.line_id, n, k, m, x1, y1, x2, y2, greatest(0, least(1, (m - upto) / len)) AS t, row_number() OVER (PARTITION BY ct.line_id, k ORDER BY seq) AS rn FROM ct JOIN up ON up.line_id = ct.line_id AND m >= upto - 1e-6 AND m <= upto + len + 1e-6) WHERE rn = 1),
pc AS (SELECT line_id, k AS chunk, m, -1 AS v, x, y FROM cp WHERE k < n UNION ALL SELECT line_id, k - 1, m, -1, x, y FROM cp WHERE k > 0 UNION ALL SELECT up.line_id, CAST(floor(upto / (wd.total / n)) AS BIGINT), upto, seq, x1, y1 FROM up JOIN wd ON wd.line_id = up.line_id WHERE abs(upto / (wd.total / n) - round(upto / (wd.total / n))) * (wd.total / n) > 1e-6),
ps AS (SELECT line_id, chunk, m, v, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS seq FROM pc WINDOW w AS (PARTITION BY line_id, chunk ORDER BY m, v))"""

_TREES = """wn AS (SELECT CAST(n_nationkey AS BIGINT) + 100 AS node, CAST(CAST(n_nationkey AS BIGINT) * 7001 % 20011 AS DOUBLE) AS x, CAST(CAST(n_nationkey AS BIGINT) * 5003 % 20011 AS DOUBLE) AS y FROM nation),
we AS (SELECT node AS src, x, y, unnest([(node - 99) % 25 + 100, ((node - 100) * 7 + 3) % 25 + 100]) AS dst FROM wn WHERE node % 6 <> 0), wd AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(sqrt(pow(wn.x - we.x, 2) + pow(wn.y - we.y, 2)) / 1000) AS w FROM we JOIN wn ON wn.node = we.dst WHERE src <> dst GROUP BY 1, 2),
arcs AS (SELECT a AS src, b AS dst, w FROM wd UNION ALL SELECT b, a, w FROM wd), far AS (SELECT node AS source, node, CAST(0 AS DOUBLE) AS km, 0 AS hops FROM wn WHERE node IN (100, 105, 112, 118) UNION SELECT source, dst, min(km + w), hops + 1 FROM far JOIN arcs ON src = node WHERE hops < 24 GROUP BY source, dst, hops),
ways AS (SELECT source, node, min(km) AS km FROM far GROUP BY 1, 2), tree AS (SELECT v.source, v.node, v.km, min(src) AS prev FROM ways v LEFT JOIN (SELECT u.source, u.km AS to_src, src, dst, w FROM ways u JOIN arcs ON src = u.node) t ON t.source = v.source AND t.dst = v.node AND t.to_src + t.w = v.km GROUP BY 1, 2, 3),
path AS (SELECT source, node, CAST(0 AS BIGINT) AS pos, node AS here FROM tree UNION ALL SELECT path.source, path.node, pos + 1, tree.prev FROM path JOIN tree ON tree.source = path.source AND tree.node = path.here WHERE prev IS NOT NULL)"""

def _near(lines: str, name: str) -> str:
    """The share of samples near the segments of a table, as a table."""
    t = "greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0)))"
    near = f"sqrt(pow(x - x1 - coalesce({t}, 0) * (x2 - x1), 2) + pow(y - y1 - coalesce({t}, 0) * (y2 - y1), 2)) <= 150"
    return f"{name} AS (SELECT sm.line_id, count(DISTINCT k) / 40e0 AS share FROM sm JOIN {lines} ON {near} GROUP BY 1)"


ORACLES = {
    "mode_evidence": f"""WITH {EVM}, {SUP}, {STEPS}, tk AS (SELECT user_id AS line_id, event_id AS seq, x / CASE WHEN user_id % 4 = 1 THEN 40e0 ELSE 9e0 END AS x, y / CASE WHEN user_id % 4 = 1 THEN 40e0 ELSE 9e0 END AS y FROM evm WHERE user_id % 4 <> 1 OR event_id % 3 = 0),
g0 AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE {OK}) AS ok, count(*) FILTER (WHERE {OK} AND kmh > 0.7) AS mv, quantile_cont(kmh, 0.5) FILTER (WHERE {OK} AND kmh > 0.7) AS med, avg(CAST(kmh > 12 AS DOUBLE)) FILTER (WHERE {OK} AND kmh > 0.7) AS fast FROM st WHERE user_id % 3 = 0 GROUP BY 1),
sp AS (SELECT user_id AS line_id, med, fast, CASE WHEN med >= 11 OR fast >= 0.25 THEN 'Motor road' WHEN med <= 4.5 THEN 'Foot track' END AS mode FROM g0 WHERE n >= 20 AND ok >= 20 AND mv >= 20), dc AS (SELECT * FROM sp WHERE mode IS NOT NULL),
sg AS (SELECT * FROM (SELECT line_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM tk WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL),
sv AS (SELECT * FROM (SELECT s_suppkey % 5 < 3 AS motor, x / 12 AS x1, y / 12 AS y1, lead(x / 12) OVER w AS x2, lead(y / 12) OVER w AS y2 FROM sup WINDOW w AS (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey)) WHERE x2 IS NOT NULL),
pv AS (SELECT sg.* FROM sg JOIN dc ON dc.line_id = sg.line_id AND mode = 'Motor road'), mo AS (SELECT * FROM sv WHERE motor), fo AS (SELECT * FROM sv WHERE NOT motor),
up AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seq) - len AS upto, sum(len) OVER (PARTITION BY line_id) AS total FROM (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM sg) WHERE line_id NOT IN (SELECT line_id FROM dc)),
sm AS (SELECT line_id, k, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM (SELECT line_id, k, x1, y1, x2, y2, least(1e0, greatest(0e0, (k * total / 39 - upto) / nullif(len, 0))) AS t, row_number() OVER (PARTITION BY line_id, k ORDER BY seq DESC) AS rn FROM up, (SELECT unnest(range(40)) AS k) WHERE upto <= k * total / 39 + 1e-6 AND len > 0) WHERE rn = 1),
{_near("pv", "ov")}, {_near("mo", "nm")}, {_near("fo", "nf")}, gr AS (SELECT user_id AS line_id, quantile_cont(value, 0.85) / 25 AS p85 FROM events GROUP BY 1),
a AS (SELECT t.line_id, dc.mode AS by_speed, med, fast, p85, coalesce(ov.share, 0) AS overlap, coalesce(nm.share, 0) AS motor, coalesce(nf.share, 0) AS foot FROM (SELECT DISTINCT line_id FROM tk) t LEFT JOIN dc ON dc.line_id = t.line_id LEFT JOIN ov ON ov.line_id = t.line_id LEFT JOIN nm ON nm.line_id = t.line_id LEFT JOIN nf ON nf.line_id = t.line_id LEFT JOIN gr ON gr.line_id = t.line_id),
b AS (SELECT *, CASE WHEN by_speed IS NOT NULL THEN 1 WHEN overlap >= 0.95 THEN 2 WHEN (SELECT count(*) FROM sup) = 0 THEN 6 WHEN motor >= 0.7 AND motor > foot AND p85 <= 18 THEN 3 WHEN p85 > 18 THEN 4 ELSE 5 END AS rung FROM a)
SELECT line_id, CASE WHEN rung = 1 THEN by_speed WHEN rung IN (2, 3) THEN 'Motor road' ELSE 'Foot track' END AS mode, rung, CASE rung WHEN 1 THEN printf('speed: median %.1f km/h, %d%% fast', round_even(med, 1), CAST(round_even(fast * 100, 0) AS BIGINT)) WHEN 2 THEN printf('overlap: %d%% along a proven road', CAST(round_even(overlap * 100, 0) AS BIGINT))
WHEN 3 THEN printf('survey: %d%% follows a road', CAST(round_even(motor * 100, 0) AS BIGINT)) WHEN 4 THEN printf('gradient: %d%% is above every road', CAST(round_even(p85, 0) AS BIGINT)) WHEN 5 THEN printf('survey: %d%% follows a road, %d%% a foot track', CAST(round_even(motor * 100, 0) AS BIGINT), CAST(round_even(foot * 100, 0) AS BIGINT)) ELSE 'default' END AS why FROM b""",
    "path_rows": f"""WITH RECURSIVE {_TREES} SELECT path.source, path.node, pos, here AS "at", round_even(km, 6) AS km_left FROM path JOIN tree ON tree.source = path.source AND tree.node = here WHERE path.source IN (100, 112)""",
    "walk_access": f"""WITH RECURSIVE {SUP}, {_TREES}, st AS (SELECT node AS stop, x + node * 3 AS x, y FROM wn WHERE node IN (100, 105, 112, 118)),
sn AS (SELECT * FROM (SELECT stop, st.x, st.y, wn.node AS source, wn.x AS tx, wn.y AS ty, sqrt(pow(wn.x - st.x, 2) + pow(wn.y - st.y, 2)) AS soff, row_number() OVER (PARTITION BY stop ORDER BY sqrt(pow(wn.x - st.x, 2) + pow(wn.y - st.y, 2)), wn.node) AS rn FROM st, wn) WHERE rn = 1),
vn AS (SELECT * FROM (SELECT s_suppkey AS village, sup.x, sup.y, wn.node, wn.x AS nx, wn.y AS ny, sqrt(pow(wn.x - sup.x, 2) + pow(wn.y - sup.y, 2)) AS off, row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt(pow(wn.x - sup.x, 2) + pow(wn.y - sup.y, 2)), wn.node) AS rn FROM sup, wn) WHERE rn = 1),
tr AS (SELECT * FROM (SELECT village, vn.x, vn.y, node, nx, ny, off, stop, sn.x AS sx, sn.y AS sy, source, tx, ty, soff, row_number() OVER (PARTITION BY village ORDER BY sqrt(pow(sn.x - vn.x, 2) + pow(sn.y - vn.y, 2)), stop) AS rn FROM vn, sn) WHERE rn = 1),
w AS (SELECT tr.*, km, off <= 2000 AND soff <= 2000 AND km IS NOT NULL AS by_path FROM tr LEFT JOIN ways ON ways.source = tr.source AND ways.node = tr.node),
pt AS (SELECT village, 'path' AS part, pos AS seq, wn.x, wn.y FROM w JOIN path ON path.source = w.source AND path.node = w.node JOIN wn ON wn.node = here WHERE by_path UNION ALL SELECT village, 'start', 0, x, y FROM w WHERE by_path AND off > 1 UNION ALL SELECT village, 'start', 1, nx, ny FROM w WHERE by_path AND off > 1
UNION ALL SELECT village, 'end', 0, tx, ty FROM w WHERE by_path AND soff > 1 UNION ALL SELECT village, 'end', 1, sx, sy FROM w WHERE by_path AND soff > 1 UNION ALL SELECT village, 'straight', 0, x, y FROM w WHERE NOT by_path UNION ALL SELECT village, 'straight', 1, sx, sy FROM w WHERE NOT by_path),
bo AS (SELECT village, part, false AS back, seq, x, y FROM pt UNION ALL SELECT village, part, true, -seq, x, y FROM pt), sg AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM bo WINDOW o AS (PARTITION BY village, part, back ORDER BY seq)),
ln AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS len FROM sg WHERE x2 IS NOT NULL), up AS (SELECT *, sum(len) OVER (PARTITION BY village, part, back ORDER BY seq) - len AS upto, sum(len) OVER (PARTITION BY village, part, back) AS total FROM ln WHERE len > 0),
nk AS (SELECT village, part, back, any_value(total) AS total, greatest(CAST(floor(any_value(total) / 60) AS BIGINT), 2) AS n FROM up GROUP BY 1, 2, 3), ks AS (SELECT *, k * total / n AS m FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM nk)),
sp AS (SELECT * FROM (SELECT ks.village, ks.part, ks.back, k, x + least(1, greatest(0, (m - upto) / len)) * (x2 - x) AS px, y + least(1, greatest(0, (m - upto) / len)) * (y2 - y) AS py, row_number() OVER (PARTITION BY ks.village, ks.part, ks.back, k ORDER BY seq) AS rn FROM ks JOIN up ON up.village = ks.village AND up.part = ks.part AND up.back = ks.back AND m >= upto - 1e-6 AND m <= upto + len + 1e-6) WHERE rn = 1),
hz AS (SELECT CAST(p_partkey % 100 AS INT) AS k, avg(p_size) * 8 AS z FROM part GROUP BY 1), sz AS (SELECT sp.*, z FROM sp LEFT JOIN hz ON hz.k = CAST(greatest(0, least(9, floor((20011 - py) / 2001.1e0))) AS INT) * 10 + CAST(greatest(0, least(9, floor(px / 2001.1e0))) AS INT)),
dz AS (SELECT village, back, k, greatest(sqrt(pow(px - lag(px) OVER o, 2) + pow(py - lag(py) OVER o, 2)), 1e-6) AS d, z - lag(z) OVER o AS rise FROM sz WINDOW o AS (PARTITION BY village, part, back ORDER BY k)),
h AS (SELECT village, sum(d / 1000 / greatest(6 * exp(-3.5 * abs(coalesce(rise, 0) / d + 0.05)), 0.05)) FILTER (NOT back) AS hours, sum(d / 1000 / greatest(6 * exp(-3.5 * abs(coalesce(rise, 0) / d + 0.05)), 0.05)) FILTER (back) AS hours_back FROM dz WHERE k > 0 GROUP BY 1)
SELECT w.village, stop, CASE WHEN by_path THEN 'path network' ELSE 'straight line' END AS basis, round_even(CASE WHEN by_path THEN km * 1000 + CASE WHEN off > 1 THEN off ELSE 0 END + CASE WHEN soff > 1 THEN soff ELSE 0 END ELSE sqrt(pow(sx - w.x, 2) + pow(sy - w.y, 2)) END, 3) AS metres, round_even(coalesce(hours, 0), 5) AS hours, round_even(coalesce(hours_back, 0), 5) AS hours_back FROM w LEFT JOIN h ON h.village = w.village""",
    "road_chunks": f"""WITH {_PIECES}, g AS (SELECT line_id, chunk, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS metres, count(*) AS vertices, arg_min(x1, seq) AS xa, arg_min(y1, seq) AS ya, arg_max(x1, seq) AS xb, arg_max(y1, seq) AS yb FROM ps GROUP BY 1, 2)
SELECT line_id, chunk, round_even(metres, 4) AS metres, vertices, round_even(xa, 3) + 0e0 AS x_a, round_even(ya, 3) + 0e0 AS y_a, round_even(xb, 3) + 0e0 AS x_b, round_even(yb, 3) + 0e0 AS y_b, CASE WHEN sqrt(pow(xb - xa, 2) + pow(yb - ya, 2)) > 1 THEN round_even(metres / sqrt(pow(xb - xa, 2) + pow(yb - ya, 2)), 6) END AS sinuosity FROM g""",
    "road_chunk_speeds": f"""WITH {EVM}, {_PIECES}, q AS (SELECT event_id, line_id, chunk, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM evm JOIN ps ON x BETWEEN least(x1, x2) - 200 AND greatest(x1, x2) + 200 AND y BETWEEN least(y1, y2) - 200 AND greatest(y1, y2) + 200),
t AS (SELECT *, coalesce(greatest(0, least(1, ((x - x1) * dx + (y - y1) * dy) / nullif(dx * dx + dy * dy, 0))), 0) AS t FROM q), d AS (SELECT event_id, line_id, chunk, min(sqrt(pow(x - (x1 + t * dx), 2) + pow(y - (y1 + t * dy), 2))) AS d FROM t GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY event_id) AS least_d FROM d WHERE d <= 200) WHERE d <= least_d + 1e-9), s AS (SELECT b.*, value AS kmh, user_id FROM b JOIN events USING (event_id))
SELECT line_id, chunk, round_even(avg(kmh), 6) AS mean, round_even(quantile_cont(kmh, 0.5), 6) AS median, round_even(quantile_cont(kmh, 0.15), 6) AS p15, count(*) AS n, count(DISTINCT user_id) AS runs, round_even(avg(d), 4) AS off FROM s GROUP BY 1, 2 HAVING count(*) >= 8""",
}
