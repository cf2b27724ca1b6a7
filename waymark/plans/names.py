"""Queries on names and rule classifiers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import text as tx
from waymark.operators.spatial import best_per_key
from waymark.plans.base import read

# Rules as (pattern, label) in their order of precedence, words and kinds, stop words.
TYPE_RULES = (("copper|brass", "Garden"), (r"\bsteel\b", "Road"), ("nickel|tin", "Garden"))
KIND_RULES = (("school|promo", "school"), ("market|economy", "market"), ("mission|standard", "church"), ("river|small", "water"), ("medium", "store"), ("large", "airstrip"))
KIND_WORDS = (("the", "school"), ("tion", "clinic"), ("and", "church"), ("ment", "market"), ("der", "store"))
STOP_WORDS = ("the", "of", "and", "to", "in", "de", "la", "die", "der")


def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by ordered patterns on name and kind; ``certain`` unless only the fallback held. (FIL-01)"""
    p = read(spark, sf_dir, "part")
    words = F.concat_ws(" ", "p_name", "p_type")
    return p.select("p_partkey", tx.first_match(words, TYPE_RULES, "Village").alias("type"), words.rlike("(?i)copper|brass|steel").alias("certain"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in override table: every tenth part, and as many names that do not occur."""
    p = read(spark, sf_dir, "part")
    known = p.where("p_partkey % 10 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_partkey").alias("row_no"))
    return known.union(p.where("p_partkey % 10 = 1").select(F.concat(F.lit("no such "), "p_name"), "p_brand", "p_partkey"))


def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-name override, the last row of a name wins. (FIL-02, JOI-01)"""
    p = read(spark, sf_dir, "part")
    last = overrides(spark, sf_dir).groupBy("name").agg(F.max_by("type", "row_no").alias("type"))
    return p.join(last, p["p_name"] == last["name"], "left").select("p_partkey", F.coalesce("type", "p_type").alias("type"), F.col("type").isNotNull().alias("certain"))


def unknown_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override names that no row has. (JOI-05, SET-02)"""
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return overrides(spark, sf_dir).join(p, "name", "left_anti").select("name", "type")


def settlement_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First kind whose pattern matches; a settlement if none does. (FIL-09)"""
    p = read(spark, sf_dir, "part")
    kind = tx.first_match(F.concat_ws(" ", "p_name", "p_type"), KIND_RULES, None)
    return p.select("p_partkey", kind.alias("kind"), kind.isNull().alias("is_settlement"))


def kind_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds found in a text against kinds wanted: both, missing, extra. (FIL-11, SET-03)"""
    d = read(spark, sf_dir, "documents")
    found = tx.kind_set(F.col("text"), KIND_WORDS, "school")
    want = F.array_sort(F.array_distinct(F.array(F.lit("church"), F.element_at(F.array(F.lit("school"), F.lit("clinic"), F.lit("airstrip")), (F.col("doc_id") % 3 + 1).cast("int")))))
    rows = d.select("doc_id", found.alias("found"), want.alias("want"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("doc_id", joined(F.col("found")).alias("found"), joined(F.array_intersect("found", "want")).alias("hits"), joined(F.array_except("want", "found")).alias("missing"), joined(F.array_union("found", "want")).alias("all_kinds"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with recorder debris: a leading or trailing stamp, double blanks, placeholders."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    name = (
        F.when(k == 0, F.concat(F.lit("2024-01-05 10:22:33 "), "p_name"))
        .when(k == 1, F.concat(F.col("p_name"), F.lit("  2023-12-31T08:15 .,")))
        .when(k == 2, F.concat(F.lit("Saved track "), F.col("p_partkey").cast("string")))
        .when(k == 3, F.lit("   "))
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", "p_brand", name.alias("raw"))


def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamped(spark, sf_dir).select("p_partkey", tx.clean_name(F.col("raw"), F.col("p_brand")).alias("name"))


def place_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    tokens = tx.place_tokens(F.col("text"), STOP_WORDS)
    return d.select("doc_id", F.size(tokens).alias("n"), F.array_join(F.slice(tokens, 1, 5), " ").alias("first_five"))


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    name = F.concat(F.regexp_replace("s_name", "#", "/"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(" Village")).when(F.col("s_suppkey") % 3 == 1, F.lit(" 2")).otherwise(F.lit("")))
    return s.select("s_suppkey", F.posexplode(tx.name_variants(name)).alias("pos", "variant"))


def reduced_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", tx.squeeze(F.col("p_name")).alias("spelling"))


def html_note_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and plain text of the first paragraphs' markup, tags stripped. (SRC-17, STR-15)"""
    p = read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "<[^>]*>", " "), r"\s+", " "))
    return p.select("page_id", F.trim(title).alias("title"), F.length(plain).alias("n_plain"), F.md5(F.encode(plain, "utf-8")).alias("plain_md5"))


def exact_dup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with most characters, then the least id. (WIN-05, BIN-02)

    The winner is an aggregate, not a sort, so a text that is repeated very often is combined before the shuffle.
    """
    d = read(spark, sf_dir, "documents").withColumn("h", F.sha2(F.encode("text", "utf-8"), 256))
    best = d.groupBy("h").agg(F.min(F.struct(-F.col("n_chars"), "doc_id", "source")).alias("b"), F.count("*").alias("copies"))
    return best.select(F.col("b.doc_id").alias("doc_id"), F.col("b.source").alias("source"), "copies")


def dedupe_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best row of each (language, source) by length, ties by id. (WIN-05, WIN-11)"""
    d = read(spark, sf_dir, "documents").withColumn("key", F.concat_ws("/", "lang", "source"))
    return best_per_key(d, "key", F.desc("n_chars"), F.asc("doc_id")).select("key", "doc_id", "n_chars")


def spelling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of brands and types at an edit distance of at most 2, blocked by reduced spelling's first letters. (RES-06, STR-06)"""
    names = read(spark, sf_dir, "part").select(F.col("p_type").alias("name")).union(read(spark, sf_dir, "part").select("p_brand")).distinct()
    keyed = names.withColumn("block", F.substring(F.lower("name"), 1, 2))
    a, b = keyed.select("block", F.col("name").alias("a")), keyed.select("block", F.col("name").alias("b"))
    near = a.join(b, "block").where("a < b").withColumn("d", F.levenshtein("a", "b")).where("d <= 2")
    return near.select("a", "b", "d")


def spelling_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked pairs with their Ratcliff-Obershelp ratio, at least 0.80. (STR-06, STR-07)"""
    return spelling_pairs(spark, sf_dir).withColumn("ratio", F.bround(tx.sequence_ratio(F.col("a"), F.col("b")), 6)).where("ratio >= 0.8")


def anagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of more than four letters that are anagrams of one another. (STR-08)"""
    words = read(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("w")).where("length(w) > 4").distinct()
    key = F.array_join(F.array_sort(F.split("w", "")), "")
    return words.groupBy(key.alias("letters")).agg(F.count("*").alias("n"), F.min("w").alias("first"))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in natural order: leading number, then text. (SRT-06)"""
    p = read(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"), "p_brand").distinct()
    label = F.when(F.col("digits") == "", F.col("p_brand")).otherwise(F.concat("digits", F.lit("b")))
    number, rest = tx.natural_key(F.col("label"))
    rows = p.select(label.alias("label")).distinct()
    return rows.select("label", F.row_number().over(tx_window(number, rest)).alias("place"))


def tx_window(*cols):  # noqa: ANN002, ANN201
    from pyspark.sql import Window

    return Window.orderBy(*cols)


QUERIES = {
    f.__name__: f
    for f in (
        rule_classify, override_apply, unknown_overrides, settlement_kind, kind_sets, clean_name, place_tokens, name_variants, reduced_spelling,
        html_note_extract, exact_dup_keep_best, dedupe_tiebreak, spelling_pairs, spelling_ratio, anagrams, natural_sort,
    )
}

_OV = "ov AS (SELECT p_name AS name, p_brand AS type, p_partkey AS row_no FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'no such ' || p_name, p_brand, p_partkey FROM part WHERE p_partkey % 10 = 1)"
_KINDS = " ".join(f"WHEN regexp_matches(w, '(?i){p}') THEN '{k}'" for p, k in KIND_RULES)
_SETS = ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{k}' END" for w, k in KIND_WORDS)
_RAW = """raw AS (SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN '2024-01-05 10:22:33 ' || p_name WHEN 1 THEN p_name || '  2023-12-31T08:15 .,' WHEN 2 THEN 'Saved track ' || p_partkey WHEN 3 THEN '   ' ELSE p_name END AS raw FROM part)"""
_STAMP = r"\d{4}-\d{2}-\d{2}(?:[ T_]\d{2}[:.-]?\d{2}(?:[:.-]?\d{2})?)?"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLES = {
    "rule_classify": r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name || ' ' || p_type, '(?i)copper|brass') THEN 'Garden' WHEN regexp_matches(p_name || ' ' || p_type, '(?i)\bsteel\b') THEN 'Road' WHEN regexp_matches(p_name || ' ' || p_type, '(?i)nickel|tin') THEN 'Garden' ELSE 'Village' END AS type,
regexp_matches(p_name || ' ' || p_type, '(?i)copper|brass|steel') AS certain FROM part""",
    "override_apply": f"WITH {_OV}, l AS (SELECT name, arg_max(type, row_no) AS type FROM ov GROUP BY name) SELECT p_partkey, coalesce(l.type, p_type) AS type, l.type IS NOT NULL AS certain FROM part LEFT JOIN l ON l.name = p_name",
    "unknown_overrides": f"WITH {_OV} SELECT name, type FROM ov WHERE name NOT IN (SELECT p_name FROM part WHERE p_name IS NOT NULL)",
    "settlement_kind": f"WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS w FROM part), k AS (SELECT p_partkey, CASE {_KINDS} END AS kind FROM t) SELECT p_partkey, kind, kind IS NULL AS is_settlement FROM k",
    "kind_sets": f"""WITH f AS (SELECT doc_id, list_distinct(list_filter([{_SETS}], lambda x: x IS NOT NULL)) AS f0, list_distinct(['church', ['school', 'clinic', 'airstrip'][CAST(doc_id % 3 AS INT) + 1]]) AS want FROM documents),
g AS (SELECT doc_id, CASE WHEN len(f0) = 0 THEN ['school'] ELSE f0 END AS found, want FROM f)
SELECT doc_id, array_to_string(list_sort(found), ',') AS found, array_to_string(list_sort(list_filter(found, lambda x: list_contains(want, x))), ',') AS hits, array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(found, x))), ',') AS missing, array_to_string(list_sort(list_distinct(list_concat(found, want))), ',') AS all_kinds FROM g""",
    "clean_name": f"""WITH {_RAW}, s AS (SELECT p_partkey, p_brand, regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '^{_STAMP}\\s*', ''), '\\s*{_STAMP}$', '')), '[ .:,;-]+$', '') AS own FROM raw)
SELECT p_partkey, CASE WHEN own = '' OR lower(own) LIKE 'saved track%' THEN p_brand ELSE own END AS name FROM s""",
    "place_tokens": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, '''s', ''), '([A-Z][A-Za-z]+\\d*)', 1)) AS w, generate_subscripts(regexp_extract_all(replace(text, '''s', ''), '([A-Z][A-Za-z]+\\d*)', 1), 1) AS i FROM documents),
f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE lower(w) NOT IN ({_STOPS}) GROUP BY doc_id, w), g AS (SELECT doc_id, list(w ORDER BY i) AS t FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(t), 0) AS INT) AS n, coalesce(array_to_string(t[1:5], ' '), '') AS first_five FROM documents d LEFT JOIN g USING (doc_id)""",
    "name_variants": """WITH n AS (SELECT s_suppkey, replace(s_name, '#', '/') || CASE s_suppkey % 3 WHEN 0 THEN ' Village' WHEN 1 THEN ' 2' ELSE '' END AS nm FROM supplier),
b AS (SELECT s_suppkey, nm, trim(regexp_replace(nm, '(?i)\\s+(village|station)$', '')) AS bare FROM n),
v AS (SELECT s_suppkey, list_concat([trim(nm), bare, trim(regexp_replace(bare, '\\s*[12]$', ''))], list_transform(string_split_regex(bare, '[/()]'), lambda x: trim(x))) AS vs FROM b),
e AS (SELECT s_suppkey, unnest(vs) AS variant, generate_subscripts(vs, 1) AS i FROM v), f AS (SELECT s_suppkey, variant, min(i) AS i FROM e WHERE variant <> '' GROUP BY s_suppkey, variant)
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY i) - 1 AS INT) AS pos, variant FROM f""",
    "reduced_spelling": "SELECT p_partkey, " + "regexp_replace(" * 22 + "translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'wcjq', 'ukyk')" + "".join(f", '{c}{c}+', '{c}', 'g')" for c in "abdefghiklmnoprstuvxyz") + " AS spelling FROM part",
    "html_note_extract": """WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages)
SELECT page_id, title, CAST(length(plain) AS INT) AS n_plain, md5(plain) AS plain_md5 FROM t""",
    "exact_dup_keep_best": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) SELECT doc_id, source, copies FROM r WHERE rn = 1",
    "dedupe_tiebreak": "WITH r AS (SELECT lang || '/' || source AS key, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT key, doc_id, n_chars FROM r WHERE rn = 1",
    "spelling_pairs": "WITH n AS (SELECT DISTINCT name, substr(lower(name), 1, 2) AS block FROM (SELECT p_type AS name FROM part UNION ALL SELECT p_brand FROM part)) SELECT a.name AS a, b.name AS b, CAST(levenshtein(a.name, b.name) AS INT) AS d FROM n a JOIN n b ON a.block = b.block AND a.name < b.name WHERE levenshtein(a.name, b.name) <= 2",
    "anagrams": "WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(p_name), '[^a-z]+')) AS w FROM part) SELECT array_to_string(list_sort(string_split(w, '')), '') AS letters, count(*) AS n, min(w) AS first FROM w WHERE length(w) > 4 GROUP BY 1",
    "natural_sort": "WITH l AS (SELECT DISTINCT CASE WHEN regexp_replace(p_brand, '[^0-9]', '', 'g') = '' THEN p_brand ELSE regexp_replace(p_brand, '[^0-9]', '', 'g') || 'b' END AS label FROM part) SELECT label, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(label, '^(\\d+)', 1) AS INT), 99), label) AS INT) AS place FROM l",
}
