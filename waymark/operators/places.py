"""Place resolution and reconciliation of named things. (RES-03, RES-04, RES-11, JOI-15, JOI-18, JOI-19, JOI-24, JOI-25, FIL-13..22, AGG-20)

Keys are lower-cased and trimmed. Lookups are equi-joins; tiers and ties are explicit orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import equirect_m, equirect_mid_km
from waymark.functions.text import name_variants
from waymark.operators.spatial import best_tier

# Tiers of the sources (others come last), the distances of the matching rules in km, words that mark a state.
TIERS = {"team": 0, "field": 0, "gazetteer": 1}
NEAR_KM, NAME_CAP_KM, SUSPECT_KM = 1.5, 3.0, 30.0
CLOSED_WORDS, WORKING_WORDS = "closed|not working|abandoned|destroyed|empty", "working|open|operating|functional|in use"


def key(name: Column) -> Column:
    return F.lower(F.trim(name))


def tier_of(src: Column) -> Column:
    out = F.lit(2)
    for s, t in TIERS.items():
        out = F.when(F.lower(src) == s, t).otherwise(out)
    return out


def with_slashes(places: DataFrame) -> DataFrame:
    """Places once more under each half of a name with a slash. (RES-04)"""
    names = F.array_distinct(F.concat(F.array("name"), F.when(F.col("name").contains("/"), F.transform(F.split("name", "/"), lambda p: F.trim(p))).otherwise(F.array().cast("array<string>"))))
    return places.withColumn("name", F.explode(names))


def without_bad(places: DataFrame, bad: DataFrame) -> DataFrame:
    """Drops positions that were rejected for a source. (FIL-19)"""
    b = bad.select(F.col("source").alias("_bs"), key(F.col("name")).alias("_bn"))
    return places.join(b, (F.col("src") == F.col("_bs")) & (key(F.col("name")) == F.col("_bn")), "left_anti")


def candidates(asked: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(asked, lon, lat, src, tier, step)`` of ``asked(asked)``, from the first step that has any: the name as placed by the team, the
    alias's own position, the alias's target, the name in any source. One alias hop; of aliases that repeat a name the last wins. (RES-03)

    ``places(name, lon, lat, src)``, ``aliases(as_written, resolved_to, lon, lat, row_no)``; a blank target is a note, not a rename.
    """
    p = with_slashes(places).withColumns({"k": key(F.col("name")), "tier": tier_of(F.col("src"))})
    al = aliases.groupBy(key(F.col("as_written")).alias("ak")).agg(F.max_by(F.struct("resolved_to", "lon", "lat"), "row_no").alias("a"))
    q = asked.select("asked", key(F.col("asked")).alias("q")).distinct().join(al, F.col("q") == F.col("ak"), "left")
    found = lambda on, step, only=None: q.join(p if only is None else p.where(only), on == F.col("k")).select("asked", p["lon"], p["lat"], "src", "tier", F.lit(step).alias("step"))
    placed = found(F.col("q"), 0, F.col("tier") == 0)
    own = q.where("a.lon is not null and a.lat is not null").select("asked", F.col("a.lon").alias("lon"), F.col("a.lat").alias("lat"), F.lit("alias").alias("src"), F.lit(0).alias("tier"), F.lit(1).alias("step"))
    target = found(key(F.nullif(F.trim(F.col("a.resolved_to")), F.lit(""))), 2)
    return best_tier(placed.union(own).union(target).union(found(F.col("q"), 3)), "asked", "step")


def spread_km(found: DataFrame) -> DataFrame:
    """``(asked, n, spread_km)``: the greatest distance between any two candidates of a name. (AGG-20)"""
    a, b = (found.select("asked", F.col("lon").alias(f"lon_{x}"), F.col("lat").alias(f"lat_{x}")).distinct() for x in "ab")
    far = a.join(b, "asked").groupBy("asked").agg(F.max(equirect_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) / 1000).alias("spread_km"))
    return found.groupBy("asked").agg(F.count("*").alias("n")).join(far, "asked")


def pick_pairs(legs: DataFrame, found: DataFrame) -> DataFrame:
    """Each leg ``(leg, a, b)`` with the closest pair of its ends' best-tier candidates; ties by position. (JOI-15)"""
    best = best_tier(found, "asked", "tier")
    side = lambda x: best.select(F.col("asked").alias(f"_{x}"), F.struct("lon", "lat").alias(f"at_{x}"))
    both = legs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    d = equirect_m(F.col("at_a.lat"), F.col("at_a.lon"), F.col("at_b.lat"), F.col("at_b.lon"))
    out = both.groupBy("leg").agg(F.min(F.struct(d.alias("m"), "at_a", "at_b")).alias("p"))
    return out.select("leg", "p.m", "p.at_a", "p.at_b")


def match_profile(profile: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(village, place, variant)``: each village's first spelling variant that a place has, directly or through an alias. (JOI-19, RES-10)"""
    v = profile.select("village", F.posexplode(name_variants(F.col("village"))).alias("variant", "spelling")).withColumn("k", key(F.col("spelling")))
    p = places.select("name", key(F.col("name")).alias("pk")).distinct()
    direct = v.join(p, F.col("k") == F.col("pk")).select("village", "variant", F.lit(0).alias("route"), "name")
    a = aliases.where("trim(resolved_to) <> ''").select(key(F.col("as_written")).alias("ak"), key(F.col("resolved_to")).alias("to"))
    via = v.join(a, F.col("k") == F.col("ak")).join(p, F.col("to") == F.col("pk")).select("village", "variant", F.lit(1).alias("route"), "name")
    best = direct.union(via).groupBy("village").agg(F.min(F.struct("variant", "route", "name")).alias("m"))
    return best.select("village", F.col("m.name").alias("place"), F.col("m.variant").alias("variant"))


def spellings(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(name, spelling)``: a name, what it is an alias of, and its aliases; one hop both ways. (RES-11)"""
    n = names.select("name", key(F.col("name")).alias("k")).distinct()
    a = aliases.where("trim(resolved_to) <> ''").select(key(F.col("as_written")).alias("f"), key(F.col("resolved_to")).alias("t"))
    there = n.join(a, F.col("k") == F.col("f")).select("name", F.col("t").alias("spelling"))
    back = n.join(a, F.col("k") == F.col("t")).select("name", F.col("f").alias("spelling"))
    return n.select("name", F.col("k").alias("spelling")).union(there).union(back).distinct()


def facility_points(wanted: DataFrame, points: DataFrame) -> DataFrame:
    """``(wid, pid, how)``: points that may be a wanted facility, by name within 3 km or by place within 1.5 km. (JOI-18)

    ``wanted(wid, kinds, village, lon, lat)``, ``points(pid, kinds, names, lon, lat)`` with ``names`` the places its text names. Both
    need a common kind. A point that names another village is not matched by place. The join is by kind, so only rows of one kind meet.
    """
    w = wanted.select("*", F.explode("kinds").alias("kind")).select("wid", "kind", key(F.col("village")).alias("v"), F.col("lon").alias("wx"), F.col("lat").alias("wy"))
    p = points.select("pid", F.explode("kinds").alias("kind"), F.transform("names", lambda n: F.lower(F.trim(n))).alias("names"), F.col("lon").alias("px"), F.col("lat").alias("py"))
    both = w.join(p, "kind").withColumn("km", equirect_mid_km(F.col("wy"), F.col("wx"), F.col("py"), F.col("px")))
    named = F.array_contains("names", F.col("v")) & (F.col("km").isNull() | (F.col("km") <= NAME_CAP_KM))
    near = (F.col("km") <= NEAR_KM) & (F.size("names") == 0)
    how = F.when(named, "name").when(near, "place")
    return both.withColumn("how", how).where("how is not null").groupBy("wid", "pid").agg(F.min("how").alias("how"))


def service_status(name: Column, notes: Column) -> Column:
    """closed, working or unknown: an old or former name is closed; else the first note that says either, closed first within a note. (FIL-13)"""
    says = F.transform(notes, lambda n: F.when(n.rlike(f"(?i){CLOSED_WORDS}"), "closed").when(n.rlike(f"(?i){WORKING_WORDS}"), "working"))
    return F.when(name.rlike(r"(?i)\b(old|former)\b"), "closed").otherwise(F.coalesce(F.get(F.array_compact(says), F.lit(0)), F.lit("unknown")))


def institution(name: Column, kinds: Sequence[str]) -> Column:
    """The name up to and with its kind word; a track that leads to a place is none; Center is Centre. (FIL-15)"""
    cut = F.regexp_extract(name, rf"(?i)^(.*?\b(?:{'|'.join(kinds)})\b)", 1)
    own = F.regexp_replace(F.when(cut == "", name).otherwise(cut), "Center", "Centre")
    return F.when(~F.lower(name).startswith("track leading to"), F.trim(own))


def photo_rank(name: Column, inst: Column, ancillary: str = "toilet|tank|house|fence|sign", main: str = "building|classroom|ward|office") -> Column:
    """0 the institution itself, 1 a main part, 2 any other, 3 ancillary. (FIL-14)"""
    aside = name.rlike(f"(?i){ancillary}")
    return F.when(key(name) == key(inst), 0).when(name.rlike(f"(?i){main}") & ~aside, 1).when(~aside, 2).otherwise(3)


def village_name(name: Column) -> Column:
    """A village or hamlet waypoint's name without the type word, unless it has a comma; null for other waypoints. (FIL-16, FIL-17)"""
    own = F.when(name.contains(","), F.trim(name)).otherwise(F.trim(F.regexp_replace(name, r"(?i)\b(village|hamlet)\b", "")))
    return F.when(name.rlike(r"(?i)\b(village|hamlet)\b"), F.nullif(own, F.lit("")))


def geocode_verdict(km_from_anchor: Column) -> Column:
    """no anchor, plausible up to 30 km, SUSPECT beyond. (FIL-21)"""
    return F.when(km_from_anchor.isNull(), "no anchor").when(km_from_anchor <= SUSPECT_KM, "plausible").otherwise("SUSPECT")


def refine_rounded(stops: DataFrame, survey: DataFrame) -> DataFrame:
    """Stops whose position is given to two places only take the survey's position of their name. (JOI-24)"""
    s = survey.select(key(F.col("name")).alias("sk"), F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    rounded = (F.abs(F.col("lat") * 100 - F.round(F.col("lat") * 100)) < 1e-9) & (F.abs(F.col("lon") * 100 - F.round(F.col("lon") * 100)) < 1e-9)
    use = rounded & F.col("slon").isNotNull()
    out = stops.join(s, key(F.col("name")) == F.col("sk"), "left")
    return out.withColumns({"lon": F.when(use, F.col("slon")).otherwise(F.col("lon")), "lat": F.when(use, F.col("slat")).otherwise(F.col("lat"))}).drop("sk", "slon", "slat")


def sent_version(sent: DataFrame, returned: DataFrame) -> DataFrame:
    """The sent version ``(version, shared)`` that shares most names with what came back; the first on a tie. (JOI-25)"""
    shared = sent.select("version", "name").distinct().join(returned.select("name").distinct(), "name", "left_semi").groupBy("version").agg(F.count("*").alias("shared"))
    return shared.orderBy(F.desc("shared"), "version").limit(1)


def neighbours(chains: DataFrame) -> DataFrame:
    """``(place, neighbour)``: what stands before or after a place in any chain ``(chain, seq, place)``. (JOI-20)"""
    w = Window.partitionBy("chain").orderBy("seq")
    beside = chains.select("place", F.array_compact(F.array(F.lag("place").over(w), F.lead("place").over(w))).alias("beside"))
    both = beside.select("place", F.explode("beside").alias("neighbour"))
    return both.where("place <> neighbour").distinct()
