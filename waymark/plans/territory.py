"""Queries on faces and territory, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import faces as fc
from waymark.operators import lines as ln
from waymark.plans.base import EVM, SUP, event_metres, read, supplier_points
from waymark.plans.roads import road_lines

#: Side of the square that all places lie on, cells of the fill's grid, and the level of its river.
SIDE, CELL, RIVER = 20011.0, 2001.1, 10500.0
#: Strips of the grid: its rows, that of the river in two.
STRIPS = sorted({*(round(k * CELL, 1) for k in range(11)), RIVER})


def square(spark: SparkSession) -> DataFrame:
    ring = [(0.0, 0.0, SIDE, 0.0), (SIDE, 0.0, SIDE, SIDE), (SIDE, SIDE, 0.0, SIDE), (0.0, SIDE, 0.0, 0.0)]
    return spark.createDataFrame(ring, "x1 double, y1 double, x2 double, y2 double")


def lines_of(*edges: DataFrame) -> DataFrame:
    """Edges of several tables as lines of two points."""
    every = edges[0].select("x1", "y1", "x2", "y2")
    for e in edges[1:]:
        every = every.unionByName(e.select("x1", "y1", "x2", "y2"))
    return fc.edge_points(every)


def rivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight river across the square for each nation."""
    k = F.col("n_nationkey")
    at, slope = (k * 7001 % 20011).cast("double"), (k * 37 % 21 - 10) / 10.0
    return read(spark, sf_dir, "nation").select(F.lit(-100.0).alias("x1"), (at - 100 * slope).alias("y1"), F.lit(SIDE + 100).alias("x2"), (at + (SIDE + 100) * slope).alias("y2"))


def territory_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square cut by rivers into fragments, each given to the zone with most of its villages, else to the nearest village's; the events in it. (GEO-17, GEO-03, GEO-05)"""
    faces = fc.faces_of(ln.noded(lines_of(square(spark), rivers(spark, sf_dir)), 500.0, digits=6))
    villages = supplier_points(spark, sf_dir).select(F.when(F.col("s_nationkey") % 2 == 0, "8").otherwise("9").alias("zone"), (F.col("x") + 0.125).alias("x"), (F.col("y") + 0.125).alias("y"))
    events = event_metres(spark, sf_dir).select("event_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.25).alias("y"))
    own = fc.located(events, "event_id", faces).groupBy("face").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"))
    return fc.fragment_zones(faces, villages).join(own, "face").select("first_event", "events", F.bround(F.col("area") / 10_000, 1).alias("ha"), "zone", "villages")


def open_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells claimed by suppliers for two zones; what is open goes to the zone that it adjoins, cut along a river. (GEO-18)"""
    cells = supplier_points(spark, sf_dir).groupBy(F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy")).agg(F.min("s_suppkey").alias("s"))
    cells = cells.where("(cx * 7 + cy * 3) % 4 <> 0").select("cx", "cy", F.when(F.col("s") % 2 == 0, "8").otherwise("9").alias("zone"))
    x0, y0, x1, y1 = (F.bround(c * CELL, 1) for c in (F.col("cx"), F.col("cy"), F.col("cx") + 1, F.col("cy") + 1))
    side = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    rings = cells.select("zone", F.explode(F.array(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0))).alias("e")).select("zone", "e.*")
    river = spark.createDataFrame([(-10.0, RIVER, SIDE + 10, RIVER)], "x1 double, y1 double, x2 double, y2 double")
    faces = fc.faces_of(ln.noded(lines_of(square(spark), rings, river), 500.0, digits=6))
    out = fc.filled(faces, square(spark), rings, ["8", "9"])
    middles = [(k * 100 + c, (c + 0.5) * CELL, (a + b) / 2) for k, (a, b) in enumerate(zip(STRIPS, STRIPS[1:], strict=False)) for c in range(10)]
    named = fc.located(spark.createDataFrame(middles, "cell long, x double, y double"), "cell", faces).groupBy("face").agg(F.min("cell").alias("first_cell"))
    return out.join(named, "face").select("first_cell", F.bround(F.col("area") / 10_000, 1).alias("ha"), "zone", "taken")


def corridor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the ground within 500 m of three roads, by the union of the roads' buffers. (GEO-12)"""
    roads = road_lines(spark, sf_dir).where("line_id < 3")
    buffer = fc.buffered(roads, 500.0)
    events = event_metres(spark, sf_dir).select("event_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.25).alias("y"))
    return fc.located(events, "event_id", buffer.faces).join(buffer.covered.select("face"), "face").select("event_id")


QUERIES = {f.__name__: f for f in (territory_fragments, open_ground, corridor_events)}

_SIGNS = "(SELECT string_agg(CASE WHEN {y} > l.a + l.b * {x} THEN '1' ELSE '0' END, '' ORDER BY l.i) FROM rv l)"
_STRIPS = ", ".join(f"({k}, {a!r}e0, {b!r}e0)" for k, (a, b) in enumerate(zip(STRIPS, STRIPS[1:], strict=False)))

ORACLES = {
    "corridor_events": f"""WITH {EVM}, {SUP}, g AS (SELECT x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lag(x) OVER w AS x0 FROM sup WHERE s_suppkey % 5 < 3 WINDOW w AS (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey)), s AS (SELECT x1, y1, coalesce(x2, x1) AS x2, coalesce(y2, y1) AS y2 FROM g WHERE x2 IS NOT NULL OR x0 IS NULL),
k AS (SELECT cos((k + 0.5) * 2 * pi() / 64) AS c, sin((k + 0.5) * 2 * pi() / 64) AS s, cos(k * 2 * pi() / 64) AS vc, sin(k * 2 * pi() / 64) AS vs FROM (SELECT unnest(range(64)) AS k)),
p AS (SELECT event_id, x + 0.25 AS x, y + 0.25 AS y, x1, y1, x2, y2 FROM evm JOIN s ON x + 0.25 BETWEEN least(x1, x2) - 501 AND greatest(x1, x2) + 501 AND y + 0.25 BETWEEN least(y1, y2) - 501 AND greatest(y1, y2) + 501),
q AS (SELECT event_id, x1, y1, x2, y2, bool_and(k.c * x + k.s * y <= greatest(k.c * x1 + k.s * y1, k.c * x2 + k.s * y2) + 500 * cos(pi() / 64)) AND any_value(abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))) <= 500 * max(abs((x2 - x1) * k.vs - (y2 - y1) * k.vc)) AS held FROM p, k GROUP BY event_id, x1, y1, x2, y2)
SELECT DISTINCT event_id FROM q WHERE held""",
    "territory_fragments": f"""WITH {EVM}, {SUP}, rv AS (SELECT n_nationkey AS i, CAST(n_nationkey * 7001 % 20011 AS DOUBLE) AS a, (n_nationkey * 37 % 21 - 10) / 10e0 AS b FROM nation),
ln AS (SELECT i, a, b, CASE WHEN b = 0 THEN 0e0 ELSE greatest(0e0, least((0 - a) / b, (20011 - a) / b)) END AS lo, CASE WHEN b = 0 THEN 20011e0 ELSE least(20011e0, greatest((0 - a) / b, (20011 - a) / b)) END AS hi FROM rv),
cx AS (SELECT i, a, b, lo AS x FROM ln WHERE lo < hi UNION SELECT i, a, b, hi FROM ln WHERE lo < hi UNION SELECT p.i, p.a, p.b, (q.a - p.a) / (p.b - q.b) FROM ln p JOIN ln q ON p.b <> q.b AND (q.a - p.a) / (p.b - q.b) > p.lo AND (q.a - p.a) / (p.b - q.b) < p.hi),
pc AS (SELECT i, x AS x1, a + b * x AS y1, lead(x) OVER w AS x2, a + b * lead(x) OVER w AS y2 FROM cx WINDOW w AS (PARTITION BY i ORDER BY x)), pm AS (SELECT i, x1, y1, x2, y2, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM pc WHERE x2 - x1 > 1e-7),
ps AS (SELECT pm.*, (SELECT string_agg(CASE WHEN l.i = pm.i THEN '#' WHEN pm.my > l.a + l.b * pm.mx THEN '1' ELSE '0' END, '' ORDER BY l.i) FROM rv l) AS s FROM pm),
bx AS (SELECT s AS side, t FROM (SELECT unnest([0, 1, 2, 3]) AS s), (SELECT unnest([0e0, 20011e0]) AS t) UNION SELECT 0, (0 - a) / b FROM rv WHERE b <> 0 UNION SELECT 2, (20011 - a) / b FROM rv WHERE b <> 0 UNION SELECT 1, a + b * 20011 FROM rv UNION SELECT 3, a FROM rv),
bp AS (SELECT side, t AS t1, lead(t) OVER (PARTITION BY side ORDER BY t) AS t2 FROM bx WHERE t BETWEEN 0 AND 20011),
be AS (SELECT CASE side WHEN 0 THEN t1 WHEN 1 THEN 20011 WHEN 2 THEN t2 ELSE 0 END AS x1, CASE side WHEN 0 THEN 0 WHEN 1 THEN t1 WHEN 2 THEN 20011 ELSE t2 END AS y1, CASE side WHEN 0 THEN t2 WHEN 1 THEN 20011 WHEN 2 THEN t1 ELSE 0 END AS x2, CASE side WHEN 0 THEN 0 WHEN 1 THEN t2 WHEN 2 THEN 20011 ELSE t1 END AS y2 FROM bp WHERE t2 - t1 > 1e-7),
ed AS (SELECT replace(s, '#', '1') AS s, x1, y1, x2, y2 FROM ps UNION ALL SELECT replace(s, '#', '0'), x2, y2, x1, y1 FROM ps UNION ALL SELECT {_SIGNS.format(x="(be.x1 + be.x2) / 2", y="(be.y1 + be.y2) / 2")}, x1, y1, x2, y2 FROM be),
ar AS (SELECT s, sum(x1 * y2 - x2 * y1) / 2 AS area, (min(y1) + max(y1)) / 2 AS mid FROM ed GROUP BY 1), lv AS (SELECT ed.s, (min(y1) FILTER (y1 > mid) + max(y1) FILTER (y1 <= mid)) / 2 AS y FROM ed JOIN ar ON ar.s = ed.s GROUP BY 1),
ip AS (SELECT lv.s, y, avg(x1 + (y - y1) * (x2 - x1) / (y2 - y1)) AS x FROM lv JOIN ed ON ed.s = lv.s AND (y1 > y) <> (y2 > y) GROUP BY 1, 2),
vl AS (SELECT s_suppkey, x + 0.125 AS x, y + 0.125 AS y, CASE WHEN s_nationkey % 2 = 0 THEN '8' ELSE '9' END AS zone FROM sup), vs AS (SELECT vl.*, {_SIGNS.format(x="vl.x", y="vl.y")} AS s FROM vl),
vc AS (SELECT s, sum(n) AS villages, arg_min(zone, struct_pack(n := -n, zone := zone)) AS zone FROM (SELECT s, zone, count(*) AS n FROM vs GROUP BY 1, 2) GROUP BY 1),
nr AS (SELECT s, zone FROM (SELECT ip.s, zone, row_number() OVER (PARTITION BY ip.s ORDER BY sqrt(pow(vl.x - ip.x, 2) + pow(vl.y - ip.y, 2)), zone) AS rn FROM ip, vl) WHERE rn = 1),
es AS (SELECT event_id, {_SIGNS.format(x="(evm.x + 0.25)", y="(evm.y + 0.25)")} AS s FROM evm)
SELECT min(event_id) AS first_event, count(*) AS events, round_even(any_value(area) / 10000, 1) AS ha, coalesce(any_value(vc.zone), any_value(nr.zone)) AS zone, CAST(coalesce(any_value(villages), 0) AS BIGINT) AS villages FROM es JOIN ar ON ar.s = es.s LEFT JOIN vc ON vc.s = es.s LEFT JOIN nr ON nr.s = es.s GROUP BY es.s""",
    "open_ground": f"""WITH RECURSIVE {SUP}, cl AS (SELECT CAST(floor(x / 2001.1e0) AS BIGINT) AS cx, CAST(floor(y / 2001.1e0) AS BIGINT) AS cy, CASE WHEN min(s_suppkey) % 2 = 0 THEN '8' ELSE '9' END AS zone FROM sup GROUP BY 1, 2), zc AS (SELECT * FROM cl WHERE (cx * 7 + cy * 3) % 4 <> 0),
st AS (SELECT * FROM (VALUES {_STRIPS}) AS t(k, y0, y1)), gr AS (SELECT k * 100 + c AS id, c, k, y0, y1, zone FROM st CROSS JOIN (SELECT unnest(range(10)) AS c) LEFT JOIN zc ON zc.cx = c AND zc.cy = CAST(floor((y0 + y1) / 2 / 2001.1e0) AS BIGINT)),
op AS (SELECT * FROM gr WHERE zone IS NULL), lk AS (SELECT a.id AS a, b.id AS b, a.k <> b.k AND greatest(a.y0, b.y0) = {RIVER!r}e0 AS wet FROM op a JOIN op b ON abs(a.c - b.c) + abs(a.k - b.k) = 1),
fr AS (SELECT id, id AS t FROM op UNION SELECT fr.id, lk.b FROM fr JOIN lk ON lk.a = fr.t AND NOT wet), f AS (SELECT id, min(t) AS f FROM fr GROUP BY 1), pr AS (SELECT id, id AS t FROM op UNION SELECT pr.id, lk.b FROM pr JOIN lk ON lk.a = pr.t), p AS (SELECT id, min(t) AS p FROM pr GROUP BY 1),
nb AS (SELECT f.f, p.p, z.zone, sqrt(pow(greatest(0, abs(o.c - z.c) - 1) * 2001.1e0, 2) + pow(greatest(0, o.y0 - z.y1, z.y0 - o.y1), 2)) AS d, CASE WHEN o.k = z.k AND abs(o.c - z.c) = 1 THEN o.y1 - o.y0 WHEN o.c = z.c AND abs(o.k - z.k) = 1 THEN 2001.1e0 ELSE 0 END AS edge FROM op o JOIN f ON f.id = o.id JOIN p ON p.id = o.id CROSS JOIN gr z WHERE z.zone IS NOT NULL),
ok AS (SELECT DISTINCT p FROM nb WHERE d = 0), g AS (SELECT f, zone, min(d) AS d, round_even(sum(edge), 3) AS edge FROM nb JOIN ok USING (p) GROUP BY 1, 2), ch AS (SELECT f, zone AS taker FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d, edge DESC, zone DESC) AS rn FROM g) WHERE rn = 1),
fa AS (SELECT f, round_even(sum((y1 - y0) * 2001.1e0) / 10000, 1) AS ha FROM op JOIN f USING (id) GROUP BY 1)
SELECT id AS first_cell, round_even((y1 - y0) * 2001.1e0 / 10000, 1) AS ha, zone, false AS taken FROM gr WHERE zone IS NOT NULL UNION ALL SELECT fa.f, ha, taker, taker IS NOT NULL FROM fa LEFT JOIN ch ON ch.f = fa.f""",
}
