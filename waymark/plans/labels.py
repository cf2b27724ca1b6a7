"""Queries on labels, roll-ups and lists, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import text as tx
from waymark.operators import linear
from waymark.plans.base import SUP, exact_mean, read, supplier_points
from waymark.plans.roads import road_lines

#: Words of a file's name that name no place.
NOISE = ("walk", "track", "road")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and places from the stems of recordings, here made of customers and dates of orders. (STR-02, STR-04, STR-12)"""
    o = read(spark, sf_dir, "orders")
    k, day = F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    names = F.array(*(F.lit(n) for n in ("Kaura", "Bo", "Sirafe-west", "Umbuara", "Asafa")))
    stem = F.concat(F.element_at(names, (k % 5 + 1).cast("int")), F.element_at(F.array(F.lit("_to_"), F.lit(" walk to "), F.lit("_"), F.lit(" To track ")), (k % 4 + 1).cast("int")), F.element_at(names, (k % 3 + 1).cast("int")), F.lit("_"), day, F.when(k % 2 == 0, F.concat(F.lit("_"), k.cast("string"))).otherwise(F.lit("_15-22")))
    return o.select("o_orderkey", stem.alias("stem")).select("o_orderkey", tx.file_label(F.col("stem")).alias("label"), F.array_join(tx.names_in_file(F.col("stem"), NOISE), ">").alias("places"), tx.alnum(F.col("stem")).alias("key"))


def facility_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages' tokens, shorter stems and plain words of facilities, here made of parts. (STR-09, STR-11, STR-14)"""
    p = read(spark, sf_dir, "part")
    kinds = F.array(*(F.lit(n) for n in ("Aid Post + CHW house", "Aid Post", "Elementary School", "Health Sub-centre", "Airstrip, grass", "Church, old", "Primary School")))
    p = p.select("p_partkey", F.concat(F.col("p_brand"), F.lit(" Govt. Station "), F.col("p_size") % 4).alias("village"), F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int")).alias("facility"))
    return p.select("p_partkey", F.array_join(tx.village_tokens(F.col("village")), " ").alias("tokens"), F.array_join(tx.shorter_stems(F.col("village")), "|").alias("stems"), tx.plain_facility(F.col("facility")).alias("plain"))


def village_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines by preferred village name: number, hectares, first ward and other names; a label of several villages stays whole. (STR-13, AGG-13)"""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", (F.col("p_partkey") % 23).alias("k"), (F.col("p_partkey") % 4).alias("kind"))
    a, b = F.concat(F.lit("place "), F.col("k")), F.concat(F.lit("Place "), (F.col("k") + 23 * F.when(F.col("kind") == 2, 1).otherwise(0)) % 40)
    p = p.withColumn("label", F.when(F.col("kind") == 0, a).when(F.col("kind") == 1, F.concat(a, F.lit(" ("), b, F.lit(")"))).otherwise(F.concat(a, F.lit(" / "), b)))
    # the preferred name of a part is its capitalised one
    parts = p.withColumn("parts", tx.compound_parts(F.col("label")))
    names = F.array_distinct(F.transform("parts", lambda x: F.initcap(x)))
    one = F.size(names) == 1
    own = parts.withColumns({"village": F.when(one, names[0]).otherwise(F.col("label")), "one": one})
    aka = F.when(F.col("one"), F.filter("parts", lambda x: F.lower(x) != F.lower("village"))).otherwise(F.col("parts"))
    out = own.withColumn("aka", aka).groupBy("village").agg(
        F.count("*").alias("outlines"), F.bround(F.sum("p_retailprice"), 2).alias("area_ha"), F.min_by("p_brand", "p_partkey").alias("ward"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("aka")))), "; ").alias("also_known_as")
    )
    return out


def settled_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of spellings of one squeezed key; those whose spellings all resolve to one place are settled and left out. (RES-07, STR-05)"""
    s = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 60).alias("k"), (F.col("c_custkey") % 7).alias("v"))
    name = F.concat(F.when(F.col("v") < 3, "Waku").when(F.col("v") < 5, "Uacu").otherwise("Wakku"), F.lit(" "), F.translate(F.col("k").cast("string"), "0123456789", "abdefghilm"))
    s = s.select(name.alias("name"), tx.squeeze(name).alias("key"), F.when(F.col("k") % 3 == 0, F.col("k")).otherwise(F.col("k") * 10 + F.col("v") % 2).alias("place")).distinct()
    out = s.groupBy("key").agg(F.count_distinct("name").alias("spellings"), F.count_distinct("place").alias("canon"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))
    return out.where("spellings > 1 AND canon > 1").select("key", "spellings", "names")


def ward_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages without a place on a lattice of three columns around their ward's anchor, in order of name. (WIN-15)"""
    s = supplier_points(spark, sf_dir)
    w = Window.partitionBy("s_nationkey").orderBy("s_name", "s_suppkey")
    k = F.row_number().over(w) - 1
    anchor = s.groupBy("s_nationkey").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    return s.withColumn("k", k).join(anchor, "s_nationkey").select("s_suppkey", F.bround(F.col("ax") + 75 * (F.col("k") % 3 - 1), 4).alias("x"), F.bround(F.col("ay") + 75 * (F.floor(F.col("k") / 3) - 1), 4).alias("y"))


def institution_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions rolled up from their points: centre, buildings, joined evidence of at most 300 characters, and the best photo by rank and time. (AGG-14, WIN-12)"""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", (F.col("event_id") % 3).alias("photos"))
    inst = e.withColumn("facility", F.concat(F.lit("Facility "), F.col("user_id") % 40))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    note = F.concat(F.col("event_type"), F.lit(" "), F.bround("value", 0).cast("long"))
    # evidence is short: only the first points in order can be within 300 characters, so a few are kept for each facility
    w = Window.partitionBy("facility").orderBy("event_id")
    notes = inst.select("facility", "event_id", note.alias("note"), F.row_number().over(w).alias("n")).where("n <= 300").groupBy("facility").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "note"))), lambda x: x["note"]), " | "), 1, 300).alias("evidence"))
    best = inst.where("photos > 0").groupBy("facility").agg(F.min_by(F.col("event_id"), F.struct(rank, "ts", "event_id")).alias("from_point"), F.sum("photos").alias("photos_available"), F.count("*").alias("points"))
    centre = inst.groupBy("facility").agg(exact_mean("value", 4).alias("centre"), F.count("*").alias("buildings"))
    return centre.join(notes, "facility").join(best, "facility", "left").select("facility", "centre", "buildings", "evidence", "from_point", "photos_available", "points")


def walk_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of a checklist that are still to be walked, by what becomes of them: out of scope or of several days (deferred), without a place at an end, or a job; with the km. (OPT-02, FIL-18, AGG-23)"""
    li = read(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "missing").otherwise("recorded")
    detail = F.when(F.col("l_linestatus") == "O", "only by the long way round").when(F.col("l_quantity") > 45, "nothing recorded joins the two").otherwise("fine")
    a, b = F.col("l_suppkey") % 37, F.col("l_partkey") % 37
    rows = li.select(status.alias("status"), detail.alias("detail"), a.alias("a"), b.alias("b"), (F.col("l_linenumber") == 7).alias("multi_day"), (F.col("l_extendedprice") / 1000).alias("km"))
    wanted = rows.where((F.col("status") == "missing") | F.col("detail").contains("the long way round") | F.col("detail").contains("nothing recorded joins"))
    fate = F.when(F.col("a").isin(5, 11) | F.col("b").isin(5, 11), "deferred: out of scope").when(F.col("multi_day"), "deferred: several days").when((F.col("a") % 9 == 8) | (F.col("b") % 9 == 8), "no place").when(F.col("a") == F.col("b"), "one place").otherwise("job")
    return wanted.groupBy(fate.alias("fate")).agg(F.count("*").alias("legs"), F.count_distinct("a", "b").alias("pairs"), F.bround(F.sum("km"), 3).alias("km"))


def named_road_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned roads of one place: recorded if a road runs within 500 m of it, else missing, with the wording of each. (FIL-08)"""
    places = supplier_points(spark, sf_dir).select("s_suppkey", (F.col("y") * 0.9 + 317).alias("x"), (F.col("x") * 0.95 + 211).alias("y"))
    pieces = road_lines(spark, sf_dir).select("line_id", F.lit(0).alias("chunk"), "seq", "x", "y")
    near = linear.nearest_piece(places, "s_suppkey", pieces, 500.0).groupBy("s_suppkey").agg(F.min("d").alias("off"))
    out = places.join(near, "s_suppkey", "left")
    return out.select("s_suppkey", F.when(F.col("off") <= 500, "recorded").otherwise("missing").alias("status"), F.bround("off", 0).cast("long").alias("off_m"))


QUERIES = {f.__name__: f for f in (file_names, facility_words, village_outlines, settled_spellings, ward_lattice, institution_photos, walk_jobs, named_road_test)}

_PLAIN = " ".join("WHEN " + " AND ".join(f"contains(lower(facility), '{w}')" for w in words) + f" THEN '{name}'" for words, name in tx.PLAIN_FACILITIES)

ORACLES = {
    "file_names": r"""WITH n AS (SELECT ['Kaura', 'Bo', 'Sirafe-west', 'Umbuara', 'Asafa'] AS n, ['_to_', ' walk to ', '_', ' To track '] AS j), s AS (SELECT o_orderkey, n[o_custkey % 5 + 1] || j[o_custkey % 4 + 1] || n[o_custkey % 3 + 1] || '_' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_custkey % 2 = 0 THEN '_' || o_custkey ELSE '_15-22' END AS stem FROM orders, n),
p AS (SELECT o_orderkey, stem, string_split(stem, '_') AS parts FROM s), q AS (SELECT *, len(parts) - coalesce(list_position(list_transform(list_reverse(parts), lambda x: regexp_matches(x, '^\d') AND (contains(x, '-') OR regexp_full_match(x, '\d+'))), false) - 1, len(parts)) AS kept FROM p),
w AS (SELECT *, regexp_replace(regexp_replace(stem, '\d{4}-\d{2}-\d{2}[_ ]?\d{0,2}-?\d{0,2}', ' ', 'g'), '[_,]+', ' ', 'g') AS plain FROM q), t AS (SELECT *, string_split_regex(plain, '(?i)\bto\b') AS ends FROM w),
f AS (SELECT *, list_filter(list_transform(ends, lambda p: list_filter(regexp_extract_all(regexp_replace(p, '(?i)\b(?:walk|track|road)\b', ' ', 'g'), '[A-Za-z][A-Za-z''’]+'), lambda x: length(x) > 2)[1]), lambda x: x IS NOT NULL) AS firsts FROM t)
SELECT o_orderkey, replace(array_to_string(parts[1:kept], ' '), '-', ' – ') AS label, CASE WHEN len(ends) >= 2 AND len(firsts) >= 2 THEN array_to_string(firsts, '>') END AS places, regexp_replace(lower(stem), '[^a-z0-9]', '', 'g') AS key FROM f""",
    "facility_words": f"""WITH p AS (SELECT p_partkey, p_brand || ' Govt. Station ' || (p_size % 4) AS village, ['Aid Post + CHW house', 'Aid Post', 'Elementary School', 'Health Sub-centre', 'Airstrip, grass', 'Church, old', 'Primary School'][p_partkey % 7 + 1] AS facility FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(village), '[^a-z0-9]', ' ', 'g')), '\\s+'), lambda w: w NOT IN ('govt', 'station', 'village', 'not', 'named', '1', '2')), ' ') AS tokens,
array_to_string(list_transform(list_reverse(range(1, len(string_split(village, ' ')))), lambda n: array_to_string(string_split(village, ' ')[1:n], ' ')), '|') AS stems, CASE {_PLAIN} ELSE string_split(lower(facility), ',')[1] END AS plain FROM p""",
    "village_outlines": r"""WITH p AS (SELECT *, p_partkey % 23 AS k, p_partkey % 4 AS kind FROM part), l AS (SELECT p_partkey, p_brand, p_retailprice, CASE kind WHEN 0 THEN 'place ' || k WHEN 1 THEN 'place ' || k || ' (Place ' || (k % 40) || ')' ELSE 'place ' || k || ' / Place ' || ((k + CASE WHEN kind = 2 THEN 23 ELSE 0 END) % 40) END AS label FROM p),
b AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(label, '[()]', '/', 'g'), '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM l), n AS (SELECT *, list_distinct(list_transform(parts, lambda x: upper(x[1]) || x[2:])) AS names FROM b),
v AS (SELECT *, CASE WHEN len(names) = 1 THEN names[1] ELSE label END AS village FROM n), a AS (SELECT v.*, unnest(CASE WHEN len(names) = 1 THEN list_filter(parts, lambda x: lower(x) <> lower(village)) ELSE parts END) AS aka FROM v),
k AS (SELECT village, string_agg(aka, '; ' ORDER BY aka) AS aka FROM (SELECT DISTINCT village, aka FROM a) GROUP BY 1)
SELECT v.village, count(*) AS outlines, round_even(sum(p_retailprice), 2) AS area_ha, arg_min(p_brand, p_partkey) AS ward, coalesce(any_value(k.aka), '') AS also_known_as FROM v LEFT JOIN k ON k.village = v.village GROUP BY v.village""",
    "settled_spellings": r"""WITH s AS (SELECT c_custkey % 60 AS k, c_custkey % 7 AS v FROM customer), n AS (SELECT DISTINCT CASE WHEN v < 3 THEN 'Waku' WHEN v < 5 THEN 'Uacu' ELSE 'Wakku' END || ' ' || translate(CAST(k AS VARCHAR), '0123456789', 'abdefghilm') AS name, CASE WHEN k % 3 = 0 THEN k ELSE k * 10 + v % 2 END AS place FROM s),
l AS (SELECT *, string_split(translate(regexp_replace(lower(name), '[^a-z]', '', 'g'), 'wcjq', 'ukyk'), '') AS c FROM n), q AS (SELECT name, place, array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]), '') AS key FROM l)
SELECT key, count(DISTINCT name) AS spellings, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM q GROUP BY key HAVING count(DISTINCT name) > 1 AND count(DISTINCT place) > 1""",
    "ward_lattice": f"WITH {SUP}, k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1 AS k, avg(x) OVER (PARTITION BY s_nationkey) AS ax, avg(y) OVER (PARTITION BY s_nationkey) AS ay FROM sup) SELECT s_suppkey, round_even(ax + 75 * (k % 3 - 1), 4) AS x, round_even(ay + 75 * (k // 3 - 1), 4) AS y FROM k",
    "institution_photos": """WITH i AS (SELECT *, 'Facility ' || (user_id % 40) AS facility, event_id % 3 AS photos, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rk FROM events),
b AS (SELECT facility, arg_min(event_id, struct_pack(a := rk, b := ts, c := event_id)) AS from_point, CAST(sum(photos) AS BIGINT) AS photos_available, count(*) AS points FROM i WHERE photos > 0 GROUP BY 1)
SELECT i.facility, round_even(avg(value), 4) AS centre, count(*) AS buildings, substr(string_agg(event_type || ' ' || CAST(round_even(value, 0) AS BIGINT), ' | ' ORDER BY event_id), 1, 300) AS evidence, any_value(from_point) AS from_point, any_value(photos_available) AS photos_available, any_value(points) AS points FROM i LEFT JOIN b ON b.facility = i.facility GROUP BY i.facility""",
    "walk_jobs": """WITH r AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'missing' ELSE 'recorded' END AS status, l_linestatus = 'O' OR l_quantity > 45 AS unjoined, l_suppkey % 37 AS a, l_partkey % 37 AS b, l_linenumber = 7 AS many, l_extendedprice / 1000 AS km FROM lineitem)
SELECT CASE WHEN a IN (5, 11) OR b IN (5, 11) THEN 'deferred: out of scope' WHEN many THEN 'deferred: several days' WHEN a % 9 = 8 OR b % 9 = 8 THEN 'no place' WHEN a = b THEN 'one place' ELSE 'job' END AS fate, count(*) AS legs, count(DISTINCT a * 100 + b) AS pairs, round_even(sum(km), 3) AS km FROM r WHERE status = 'missing' OR unjoined GROUP BY 1""",
    "named_road_test": f"""WITH {SUP}, g AS (SELECT s_suppkey % 5 AS l, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM sup WINDOW w AS (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey)), p AS (SELECT s_suppkey, y * 0.9e0 + 317 AS px, x * 0.95e0 + 211 AS py FROM sup),
d AS (SELECT s_suppkey, px, py, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) AS t FROM p, g WHERE x2 IS NOT NULL), o AS (SELECT s_suppkey, min(sqrt(pow(px - x1 - t * dx, 2) + pow(py - y1 - t * dy, 2))) AS off FROM d GROUP BY 1)
SELECT p.s_suppkey, CASE WHEN off <= 500 THEN 'recorded' ELSE 'missing' END AS status, CASE WHEN off <= 500 THEN CAST(round_even(off, 0) AS BIGINT) END AS off_m FROM p LEFT JOIN o ON o.s_suppkey = p.s_suppkey""",
}
