"""Queries that resolve and reconcile tables: tiers, aliases, roll-ups, verdicts, diffs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.spatial import best_per_key, best_tier
from waymark.plans.base import read


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a place from sources of different trust: (name, tier, seq, src, val)."""
    c, s, n = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    one = c.select(F.concat(F.lit("P"), F.col("c_custkey") % 97).alias("name"), (F.col("c_custkey") % 3 + 1).cast("int").alias("tier"), F.col("c_custkey").alias("seq"), F.lit("customer").alias("src"), F.col("c_acctbal").alias("val"))
    two = s.select(F.concat(F.lit("P"), F.col("s_suppkey") % 131), (F.col("s_suppkey") % 2).cast("int"), F.col("s_suppkey") + 10_000_000, F.lit("supplier"), F.col("s_acctbal"))
    three = n.select(F.concat(F.lit("P"), F.col("n_nationkey")), F.lit(2), F.col("n_nationkey").cast("long") + 20_000_000, F.lit("nation"), F.lit(0.0))
    return one.union(two).union(three)


def tier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a name's best tier, how many, and their spread. (WIN-08, AGG-20)"""
    best = best_tier(offers(spark, sf_dir), "name", "tier")
    return best.groupBy("name").agg(F.min("tier").alias("tier"), F.count("*").alias("n"), F.bround(F.max("val") - F.min("val"), 2).alias("spread"))


def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first offer of the best rank. (WIN-09)"""
    return best_per_key(offers(spark, sf_dir), "name", F.asc("tier"), F.asc("seq")).select("name", "tier", "seq", "src")


def keep_equal_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offers of the best rank. (WIN-10)"""
    return best_tier(offers(spark, sf_dir), "name", "tier").select("name", "tier", "seq", "src")


def alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow aliases to their end: at most 8 hops, a name that points to itself ends. (RES-05)"""
    hops = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), F.when(F.col("n_nationkey") % 7 == 0, F.col("n_nationkey")).otherwise(F.floor(F.col("n_nationkey") / 2).cast("int")).alias("dst"))
    at = hops.select(F.col("src").alias("name"), F.col("src").alias("node"), F.lit(0).alias("depth"))
    for _ in range(8):
        step = at.join(hops, at["node"] == hops["src"], "left")
        moves = F.col("dst").isNotNull() & (F.col("dst") != F.col("node"))
        at = step.select("name", F.when(moves, F.col("dst")).otherwise(F.col("node")).alias("node"), (F.col("depth") + F.when(moves, 1).otherwise(0)).alias("depth"))
    return at.select("name", F.col("node").alias("target"), "depth")


def ward_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, counts and shares of a ward's rows, by segment. (AGG-15, AGG-11)"""
    c = read(spark, sf_dir, "customer")
    out = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("below"))
    return out.select("c_nationkey", "c_mktsegment", "n", F.bround("total", 2).alias("total"), F.bround(F.col("below") * 100 / F.col("n"), 2).alias("pct_below"))


def route_worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route's worst leg, its first leg, and how many are recorded. (AGG-08)"""
    li = read(spark, sf_dir, "lineitem")
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    out = li.groupBy("l_orderkey").agg(F.min(rank).alias("worst"), F.count_if(F.col("l_returnflag") == "N").alias("recorded"), F.count("*").alias("legs"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))
    return out


def band_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households by access class with their share, and cumulative bands. (AGG-10)"""
    o = read(spark, sf_dir, "orders")
    km = F.col("o_totalprice") / 1000
    cls = F.when(km <= 100, "near").when(km <= 300, "long").otherwise("beyond")
    by = o.groupBy(cls.alias("class")).agg(F.count("*").alias("places"), F.sum("o_custkey").alias("households"), F.count_if(km <= 50).alias("within_50"), F.count_if(km <= 200).alias("within_200"))
    whole = o.agg(F.sum("o_custkey").alias("all_households"))
    return by.join(F.broadcast(whole)).select("class", "places", "households", F.bround(F.col("households") * 100 / F.col("all_households"), 4).alias("share"), "within_50", "within_200")


def chain_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive legs of a chain, from 1. (WIN-13, JOI-20)"""
    li = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = li.select("l_orderkey", F.row_number().over(w).alias("leg"), F.col("l_partkey").alias("from_part"), F.lead("l_partkey").over(w).alias("to_part"))
    return rows.where("to_part is not null")


def leg_status_of(straight: Column, route: Column, off_a: Column, off_b: Column) -> Column:
    """Status of a leg, first match. (FIL-07, GRA-08)

    1 an end without a position: unlocated; 2, 3 ends under 200 m apart are one place: recorded if both lie on the network, else
    missing; 4 both ends on the network and no route: missing; 5 a route within the detour limit: recorded; 6 a longer route: partial;
    7 one end on the network: partial; 8 none: missing.
    """
    ok_a, ok_b = off_a <= 500, off_b <= 500
    both = ok_a & ok_b
    ratio = (route + off_a + off_b) / F.greatest(straight, F.lit(1.0))
    limit = F.when(straight <= 2500, 2.5).otherwise(1.8)
    return (
        F.when(straight.isNull(), "unlocated").when((straight < 200) & both, "recorded").when(straight < 200, "missing").when(both & route.isNull(), "missing")
        .when(both & (ratio <= limit), "recorded").when(both, "partial").when(ok_a | ok_b, "partial").otherwise("missing")
    )


def leg_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    straight = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_extendedprice") / 8)
    route = F.when(F.col("l_quantity") < 5, None).otherwise(F.col("l_extendedprice") / 8 * (1 + F.col("l_quantity") / 25))
    off_a, off_b = F.col("l_discount") * 8000, F.col("l_tax") * 10000
    status = leg_status_of(straight, route, off_a, off_b)
    ratio = F.when(straight.isNotNull(), (route + off_a + off_b) / F.greatest(straight, F.lit(1.0)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", status.alias("status"), F.bround(ratio, 4).alias("detour"))


def facility_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted kinds of a part against the kinds its suppliers' lines show. (FIL-12, JOI-18)"""
    p, li = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*(F.lit(x) for x in "abcde")), (F.col("l_suppkey") % 5 + 1).cast("int"))
    found = li.select("l_partkey", kind.alias("kind")).distinct().groupBy("l_partkey").agg(F.collect_set("kind").alias("found"))
    want = F.array_distinct(F.array(*(F.element_at(F.array(*(F.lit(x) for x in "abcde")), ((F.col("p_size") * m) % 5 + 1).cast("int")) for m in (1, 2))))
    rows = p.join(found, p["p_partkey"] == found["l_partkey"], "left").select("p_partkey", "p_size", want.alias("want"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    hits, missing = F.array_intersect("want", "found"), F.array_except("want", "found")
    verdict = F.when(F.col("p_size") % 11 == 0, "DEFERRED").when((F.size(hits) > 0) & (F.size(missing) == 0), "COLLECTED").when(F.size(hits) > 0, "PARTIAL").when(F.size("found") > 0, "LIKELY").otherwise("NOT FOUND")
    return rows.select("p_partkey", verdict.alias("verdict"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def service_status_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of a conversation that says closed or working decides; closed is tested first within a turn. (FIL-13, WIN-17)"""
    c = read(spark, sf_dir, "conversations")
    says = F.when(F.lower("text").contains("er"), F.when(F.lower("text").contains("idiot"), "closed").otherwise("working"))
    said = c.select("conv_id", "turn", "text", says.alias("says"))
    out = said.groupBy("conv_id").agg(F.min_by(F.when(F.col("says").isNotNull(), F.col("says")), F.when(F.col("says").isNotNull(), F.struct("turn", "text"))).alias("status"), F.count("*").alias("turns"))
    return out.select("conv_id", F.coalesce("status", F.lit("unknown")).alias("status"), "turns")


def set_diff_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way manifest diff: missing here, changed size, only here. (JOI-22)"""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    there = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 3).alias("size"))
    here = li.where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg((F.count("*") % 3).alias("s"))
    both = there.join(here, F.col("key") == F.col("k"), "full")
    what = F.when(F.col("k").isNull(), "missing").when(F.col("key").isNull(), "local only").when(F.col("size") != F.col("s"), "changed")
    return both.select(F.coalesce("key", "k").alias("key"), what.alias("what")).where("what is not null")


def same_size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of files of one size. (AGG-21)"""
    p = read(spark, sf_dir, "part")
    return p.groupBy("p_retailprice").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last")).where("n > 1")


def pushdown_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box filter that reaches the Parquet scan, on two columns read. (SRC-21, FIL-20)"""
    li = read(spark, sf_dir, "lineitem")
    inside = F.col("l_quantity").between(10, 20) & F.col("l_extendedprice").between(1000, 20000)
    return li.where(inside).select("l_orderkey", "l_quantity", "l_extendedprice")


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled counts, distinct values and bounds of columns. (SRC-30, FIL-25, AGG-17)"""
    e = read(spark, sf_dir, "events")
    rows = None
    for c in ("event_id", "user_id", "event_type", "value"):
        text = F.col(c).cast("string") if c != "value" else F.format_string("%.2f", "value")
        one = e.agg(F.count(F.nullif(F.trim(text), F.lit(""))).alias("filled"), F.count_distinct(F.col(c)).alias("distinct_values"), F.min(text).alias("least"), F.max(text).alias("most")).select(F.lit(c).alias("col"), "*")
        rows = one if rows is None else rows.union(one)
    return rows


def union_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns one below the other. (SET-01)"""
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


def top_k_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five slowest parts by mean quantity; ties by key. (SRT-04)"""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(F.bround(F.avg("l_quantity"), 6).alias("mean_q")).orderBy("mean_q", "l_partkey").limit(5)


def harvest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names with the set of sources that use them. (SET-04, AGG-06)"""
    rows = offers(spark, sf_dir).select("name", "src")
    return rows.distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("src")), " | ").alias("sources"), F.count("*").alias("n_sources"))


def unlocated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in details split on ' and ', with their routes. (SET-05)"""
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Z"), F.col("o_custkey") % 50, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" and Z"), F.col("o_custkey") % 31)).otherwise("")).alias("detail"))
    return d.select("o_orderkey", F.explode(F.split("detail", " and ")).alias("name")).groupBy("name").agg(F.count_distinct("o_orderkey").alias("routes"), F.min("o_orderkey").alias("first"))


def composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup on three keys with a coalesced one, and a prefix test; the first note wins. (JOI-03, JOI-04)"""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("ward"), F.when(F.col("p_partkey") % 4 == 0, None).otherwise(F.col("p_type")).alias("village"), "p_type", "p_name")
    notes = read(spark, sf_dir, "part").select(F.col("p_brand").alias("nb"), F.col("p_size").alias("nw"), F.col("p_type").alias("nv"), F.substring("p_name", 1, 4).alias("starts"), F.col("p_partkey").alias("ord"))
    hit = p.join(notes, (p["p_brand"] == notes["nb"]) & (p["ward"] == notes["nw"]) & (F.coalesce("village", "p_type") == notes["nv"]) & F.col("p_name").startswith(F.col("starts")))
    return hit.groupBy("p_partkey").agg(F.min("ord").alias("note"), F.count("*").alias("n"))


def population_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and balance of customers before and after they are spread over regions must agree. (SNK-11, SRC-16)

    Rows that the map from nation to region loses, or counts twice, show as a difference.
    """
    c = read(spark, sf_dir, "customer").where(~F.coalesce(F.col("c_name"), F.lit("")).startswith("Total"))
    nations = read(spark, sf_dir, "nation").where("n_regionkey < 4")
    spread = c.join(F.broadcast(nations), c["c_nationkey"] == nations["n_nationkey"]).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    before, after = c.agg(F.count("*").alias("rows_in")), spread.agg(F.sum("n").alias("rows_out"))
    return before.join(F.broadcast(after)).select("rows_in", "rows_out", F.col("rows_in").eqNullSafe(F.col("rows_out")).alias("holds"))


QUERIES = {
    f.__name__: f
    for f in (
        tier_resolution, best_offer, keep_equal_tier, alias_chain, ward_rollup, route_worst_status, band_shares, chain_legs, leg_status, facility_verdict, service_status_first_match,
        set_diff_manifest, same_size_groups, pushdown_bbox, profile_columns, union_schema_drift, top_k_slowest, harvest_sources, unlocated_names, composite_lookup, population_guard,
    )
}

_OFFERS = """o AS (SELECT 'P' || (c_custkey % 97) AS name, CAST(c_custkey % 3 + 1 AS INT) AS tier, c_custkey AS seq, 'customer' AS src, c_acctbal AS val FROM customer
UNION ALL SELECT 'P' || (s_suppkey % 131), CAST(s_suppkey % 2 AS INT), s_suppkey + 10000000, 'supplier', s_acctbal FROM supplier UNION ALL SELECT 'P' || n_nationkey, 2, n_nationkey + 20000000, 'nation', 0.0 FROM nation),
r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY tier) AS rk, row_number() OVER (PARTITION BY name ORDER BY tier, seq) AS rn FROM o)"""

ORACLES = {
    "tier_resolution": f"WITH {_OFFERS} SELECT name, min(tier) AS tier, count(*) AS n, round_even(max(val) - min(val), 2) AS spread FROM r WHERE rk = 1 GROUP BY name",
    "best_offer": f"WITH {_OFFERS} SELECT name, tier, seq, src FROM r WHERE rn = 1",
    "keep_equal_tier": f"WITH {_OFFERS} SELECT name, tier, seq, src FROM r WHERE rk = 1",
    "alias_chain": """WITH RECURSIVE h AS (SELECT n_nationkey AS src, CASE WHEN n_nationkey % 7 = 0 THEN n_nationkey ELSE n_nationkey // 2 END AS dst FROM nation),
c AS (SELECT src AS name, src AS node, 0 AS depth FROM h UNION ALL SELECT c.name, h.dst, c.depth + 1 FROM c JOIN h ON h.src = c.node AND h.dst <> c.node WHERE c.depth < 8)
SELECT name, arg_max(node, depth) AS target, max(depth) AS depth FROM c GROUP BY name""",
    "ward_rollup": "SELECT c_nationkey, c_mktsegment, count(*) AS n, round_even(sum(c_acctbal), 2) AS total, round_even(count(*) FILTER (WHERE c_acctbal < 0) * 100 / count(*), 2) AS pct_below FROM customer GROUP BY 1, 2",
    "route_worst_status": "SELECT l_orderkey, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS worst, count(*) FILTER (WHERE l_returnflag = 'N') AS recorded, count(*) AS legs, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS first_part FROM lineitem GROUP BY 1",
    "band_shares": "WITH o AS (SELECT *, o_totalprice / 1000 AS km FROM orders) SELECT CASE WHEN km <= 100 THEN 'near' WHEN km <= 300 THEN 'long' ELSE 'beyond' END AS class, count(*) AS places, CAST(sum(o_custkey) AS BIGINT) AS households, round_even(sum(o_custkey) * 100 / (SELECT sum(o_custkey) FROM orders), 4) AS share, count(*) FILTER (WHERE km <= 50) AS within_50, count(*) FILTER (WHERE km <= 200) AS within_200 FROM o GROUP BY 1",
    "chain_legs": "WITH l AS (SELECT l_orderkey, CAST(row_number() OVER w AS INT) AS leg, l_partkey AS from_part, lead(l_partkey) OVER w AS to_part FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) SELECT * FROM l WHERE to_part IS NOT NULL",
    "leg_status": """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 8 END AS st, CASE WHEN l_quantity < 5 THEN NULL ELSE l_extendedprice / 8 * (1 + l_quantity / 25) END AS ro, l_discount * 8000 AS a, l_tax * 10000 AS b FROM lineitem),
q AS (SELECT *, (ro + a + b) / greatest(st, 1.0) AS ratio FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN st IS NULL THEN 'unlocated' WHEN st < 200 THEN CASE WHEN a <= 500 AND b <= 500 THEN 'recorded' ELSE 'missing' END WHEN a <= 500 AND b <= 500 AND ro IS NULL THEN 'missing' WHEN a <= 500 AND b <= 500 AND ratio <= CASE WHEN st <= 2500 THEN 2.5 ELSE 1.8 END THEN 'recorded'
WHEN a <= 500 OR b <= 500 THEN 'partial' ELSE 'missing' END AS status, round_even(CASE WHEN st IS NOT NULL THEN ratio END, 4) AS detour FROM q""",
    "facility_verdict": """WITH f AS (SELECT l_partkey, list(DISTINCT ['a','b','c','d','e'][CAST(l_suppkey % 5 AS INT) + 1]) AS found FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey, p_size, list_distinct([['a','b','c','d','e'][p_size % 5 + 1], ['a','b','c','d','e'][(p_size * 2) % 5 + 1]]) AS want, coalesce(found, []) AS found FROM part LEFT JOIN f ON l_partkey = p_partkey),
v AS (SELECT *, len(list_filter(want, lambda x: list_contains(found, x))) AS hits, list_sort(list_filter(want, lambda x: NOT list_contains(found, x))) AS miss FROM r)
SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'DEFERRED' WHEN hits > 0 AND len(miss) = 0 THEN 'COLLECTED' WHEN hits > 0 THEN 'PARTIAL' WHEN len(found) > 0 THEN 'LIKELY' ELSE 'NOT FOUND' END AS verdict, array_to_string(miss, ',') AS missing FROM v""",
    "service_status_first_match": """WITH s AS (SELECT conv_id, turn, text, CASE WHEN contains(lower(text), 'er') THEN CASE WHEN contains(lower(text), 'idiot') THEN 'closed' ELSE 'working' END END AS says FROM conversations),
f AS (SELECT conv_id, says, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM s WHERE says IS NOT NULL), t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1)
SELECT t.conv_id, coalesce(f.says, 'unknown') AS status, turns FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND rn = 1""",
    "set_diff_manifest": """WITH t AS (SELECT o_orderkey AS key, o_custkey % 3 AS size FROM orders WHERE o_orderkey % 7 <> 0), h AS (SELECT l_orderkey AS k, count(*) % 3 AS s FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
b AS (SELECT coalesce(key, k) AS key, CASE WHEN k IS NULL THEN 'missing' WHEN t.key IS NULL THEN 'local only' WHEN size <> s THEN 'changed' END AS what FROM t FULL JOIN h ON t.key = h.k) SELECT * FROM b WHERE what IS NOT NULL""",
    "same_size_groups": "SELECT p_retailprice, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1 HAVING count(*) > 1",
    "pushdown_bbox": "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 1000 AND 20000",
    "profile_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(nullif(trim({t}), '')) AS filled, count(DISTINCT {c}) AS distinct_values, min({t}) AS least, max({t}) AS most FROM events"
        for c, t in (("event_id", "CAST(event_id AS VARCHAR)"), ("user_id", "CAST(user_id AS VARCHAR)"), ("event_type", "event_type"), ("value", "printf('%.2f', value)"))
    ),
    "union_schema_drift": "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier",
    "top_k_slowest": "SELECT l_partkey, round_even(avg(l_quantity), 6) AS mean_q FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 5",
    "harvest_sources": f"WITH {_OFFERS}, d AS (SELECT DISTINCT name, src FROM o) SELECT name, string_agg(src, ' | ' ORDER BY src) AS sources, count(*) AS n_sources FROM d GROUP BY 1",
    "unlocated_names": "WITH d AS (SELECT o_orderkey, 'Z' || (o_custkey % 50) || CASE WHEN o_orderkey % 2 = 0 THEN ' and Z' || (o_custkey % 31) ELSE '' END AS detail FROM orders), e AS (SELECT o_orderkey, unnest(string_split(detail, ' and ')) AS name FROM d) SELECT name, count(DISTINCT o_orderkey) AS routes, min(o_orderkey) AS first FROM e GROUP BY 1",
    "composite_lookup": "SELECT p.p_partkey, min(n.p_partkey) AS note, count(*) AS n FROM part p JOIN part n ON p.p_brand = n.p_brand AND p.p_size = n.p_size AND p.p_type = n.p_type AND starts_with(p.p_name, substr(n.p_name, 1, 4)) GROUP BY 1",
    "population_guard": "SELECT count(*) AS rows_in, count(*) FILTER (WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)) AS rows_out, count(*) FILTER (WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)) = count(*) AS holds FROM customer WHERE c_name IS NULL OR c_name NOT LIKE 'Total%'",
}
