"""Place resolution on small hand-made inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import access
from waymark.operators import places as pl

PLACES = [("Alpha", 1.0, 1.0, "gazetteer"), ("alpha", 1.1, 1.0, "inferred"), ("Beta/Gamma", 2.0, 2.0, "gazetteer"), ("Delta", 3.0, 3.0, "team"), ("Delta", 9.0, 9.0, "gazetteer")]
ALIASES = [("Alfa", "Nowhere", None, None, 1), ("alfa", "Alpha", None, None, 2), ("Note", " ", None, None, 3), ("Own", None, 7.0, 8.0, 4)]


def frames(spark):
    return spark.createDataFrame(PLACES, "name string, lon double, lat double, src string"), spark.createDataFrame(ALIASES, "as_written string, resolved_to string, lon double, lat double, row_no int")


def test_candidates_by_step(spark):
    places, aliases = frames(spark)
    asked = spark.createDataFrame([(x,) for x in ("ALPHA ", "Alfa", "gamma", "Delta", "Note", "Own", "none")], "asked string")
    got = {}
    for r in pl.candidates(asked, places, aliases).collect():
        got.setdefault(r["asked"], set()).add((r["lon"], r["step"]))
    assert got == {"ALPHA ": {(1.0, 3), (1.1, 3)}, "Alfa": {(1.0, 2), (1.1, 2)}, "gamma": {(2.0, 3)}, "Delta": {(3.0, 0)}, "Own": {(7.0, 1)}}


def test_pairs_spread_and_bad_positions(spark):
    places, aliases = frames(spark)
    asked = spark.createDataFrame([("Alpha",), ("Beta",)], "asked string")
    found = pl.candidates(asked, places, aliases)
    assert {r["asked"]: (r["n"], round(r["spread_km"])) for r in pl.spread_km(found).collect()} == {"Alpha": (2, 11), "Beta": (1, 0)}
    r = pl.pick_pairs(spark.createDataFrame([(1, "Alpha", "Beta")], "leg int, a string, b string"), found).first()
    assert (r["at_a"]["lon"], r["at_b"]["lon"]) == (1.0, 2.0)  # the gazetteer outranks the nearer inferred point
    bad = spark.createDataFrame([("inferred", "ALPHA")], "source string, name string")
    assert pl.without_bad(places, bad).count() == 4


def test_profile_spellings_versions_neighbours(spark):
    places, aliases = frames(spark)
    profile = spark.createDataFrame([("Alpha Village",), ("Alfa",), ("Zeta",), ("Delta 2",)], "village string")
    assert {(r["village"], r["place"].lower()) for r in pl.match_profile(profile, places, aliases).collect()} == {("Alpha Village", "alpha"), ("Alfa", "alpha"), ("Delta 2", "delta")}
    assert {r["spelling"] for r in pl.spellings(spark.createDataFrame([("Alpha",)], "name string"), aliases).collect()} == {"alpha", "alfa"}
    sent = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a")], "version int, name string")
    assert tuple(pl.sent_version(sent, spark.createDataFrame([("b",), ("a",), ("c",)], "name string")).first()) == (1, 2)
    chains = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 0, "c")], "chain int, seq int, place string")
    assert {tuple(r) for r in pl.neighbours(chains).collect()} == {("a", "b"), ("b", "a")}


def test_facility_points(spark):
    wanted = spark.createDataFrame([(1, ["school"], "Alpha", 148.0, -9.0), (2, ["clinic"], "Beta", 148.5, -9.0), (3, ["school"], "Beta", None, None)], "wid int, kinds array<string>, village string, lon double, lat double")
    points = spark.createDataFrame(
        [(10, ["school"], ["Alpha"], 148.02, -9.0), (11, ["school"], ["Alpha"], 148.2, -9.0), (12, ["school"], [], 148.01, -9.0), (13, ["school"], ["Beta"], 148.001, -9.0), (14, ["clinic"], [], 148.0, -9.0)],
        "pid int, kinds array<string>, names array<string>, lon double, lat double",
    )
    assert {tuple(r) for r in pl.facility_points(wanted, points).collect()} == {(1, 10, "name"), (1, 12, "place"), (3, 13, "name")}


def test_rules_on_text(spark):
    rows = spark.createDataFrame([("Old clinic", ["working"]), ("Clinic", ["nice", "not working but open", "open"]), ("Clinic", ["it is in use", "closed"]), ("Clinic", [])], "name string, notes array<string>")
    assert [r[0] for r in rows.select(pl.service_status(F.col("name"), F.col("notes"))).collect()] == ["closed", "closed", "working", "unknown"]
    names = spark.createDataFrame([("Alpha Health Center toilet",), ("Track leading to school",), ("Beta school block 2",), ("Bare",)], "n string")
    assert [r[0] for r in names.select(pl.institution(F.col("n"), ["school", "health cent(?:er|re)"])).collect()] == ["Alpha Health Centre", None, "Beta school", "Bare"]
    assert [r[0] for r in names.select(pl.photo_rank(F.col("n"), F.lit("bare"))).collect()] == [3, 2, 2, 0]
    v = spark.createDataFrame([("Kiara Village",), ("Village, upper",), ("Gate",), ("hamlet",), (None,)], "n string")
    assert [r[0] for r in v.select(pl.village_name(F.col("n"))).collect()] == ["Kiara", "Village, upper", None, None, None]
    k = spark.createDataFrame([(None,), (30.0,), (30.1,)], "k double")
    assert [r[0] for r in k.select(pl.geocode_verdict(F.col("k"))).collect()] == ["no anchor", "plausible", "SUSPECT"]


def test_rounded_stops_take_the_survey(spark):
    stops = spark.createDataFrame([("A", 148.25, -9.1), ("B", 148.251, -9.1), ("C", 1.0, 1.0)], "name string, lon double, lat double")
    survey = spark.createDataFrame([("a ", 148.2534, -9.1012), ("B", 5.0, 5.0)], "name string, lon double, lat double")
    assert {r["name"]: r["lon"] for r in pl.refine_rounded(stops, survey).collect()} == {"A": 148.2534, "B": 148.251, "C": 1.0}


def test_bridges_join_loose_ends_only(spark):
    # two lines whose ends are 100 m apart, a third whose middle is nearer than its end, and an end too far off
    at = {1: (0, 0), 2: (1000, 0), 3: (1100, 0), 4: (2000, 0), 5: (500, 50), 6: (500, 900), 7: (1050, 200), 8: (2000, 5000), 9: (3000, 5000)}
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0), (6, 7, 1.0), (5, 6, 1.0), (5, 7, 1.0), (8, 9, 1.0)], "src long, dst long, weight double")
    got = sorted((r["a"], r["b"], r["weight"]) for r in access.bridge_gaps(edges, nodes).collect())
    assert got == [(2, 3, 100.0)]


def test_nearest_at_any_distance(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0), (3, None, 1.0), (4, 5.0, 0.0)], "v long, x double, y double")
    right = spark.createDataFrame([(7, 0.0, 0.0), (8, 10.0, 0.0), (9, 10.0, 0.0)], "n long, x double, y double")
    assert sorted((r["v"], r["n"], r["d"]) for r in access.nearest_any(left, right, "v", "n", 3.0).collect()) == [(1, 7, 0.0), (2, 8, 999990.0), (4, 7, 5.0)]
    assert access.nearest_any(left, right.where("false"), "v", "n").collect() == []
