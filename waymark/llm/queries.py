"""One query for each corpus operator, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.byte_bpe import decoded, encoded
from waymark.llm.common import table
from waymark.llm.conversations import damaged, repair_digests
from waymark.llm.decontamination import contaminations
from waymark.llm.html_extraction import main_texts
from waymark.llm.importance import importance_ranks
from waymark.llm.language_id import fit, held_out, identify
from waymark.llm.line_dedup import removed_lines
from waymark.llm.mixing import mix_sources
from waymark.llm.nearest import nearest
from waymark.llm.ngram_jaccard_join import ngram_jaccard_join
from waymark.llm.quality import quality_scores
from waymark.llm.sharding import shard_slots
from waymark.llm.url_filter import SUFFIXES, judge_urls

# The rules of the URL query, as (host, path, verdict).
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out(docs))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its number: bad if of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return judge_urls(pages, pages.select("page_id", "url").join(bad, "page_id"), URL_RULES)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    out = decoded(ids, ranks, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_ngram_jaccard_join, op4_url_filter, op5_sharding,
        op6_source_mixing, op7_html_extraction, op8_quality_classifier, op9_nearest_neighbours, op10_line_dedup,
        op11_importance_resampling, op12_byte_bpe, op13_conversation_repair,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _shingles(words: str, k: int) -> str:
    """A list of the shingles of a list of words, as SQL."""
    parts = " || ' ' || ".join(f"{words}[i + {j}]" for j in range(k))
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {k} THEN [array_to_string({words}, ' ')] ELSE list_transform(range(1, len({words}) - {k - 2}), lambda i: {parts}) END"


#: Rates by level, each prior without the unit's own outcomes.
_URLS = r"""u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT host, greatest(1 - quality, toxic) AS bad FROM u JOIN labels ON labels.doc_id = u.page_id), hs AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM (SELECT host, bad FROM o UNION ALL SELECT host, NULL FROM u) GROUP BY host),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM hs), b2 AS (SELECT *, regexp_matches(bare, '^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$') AS address, array_to_string(string_split(bare, '.')[-2:], '.') AS two, two IN ({suffixes}) AS long FROM b), un AS (SELECT host, CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad, CASE WHEN address THEN bare WHEN long THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE two END AS domain, CASE WHEN address THEN '[address]' WHEN long THEN two ELSE string_split(bare, '.')[-1] END AS suffix FROM b2),
g AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS up FROM un),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(up) AS up FROM un, g GROUP BY suffix), ks AS (SELECT {k} AS k FROM s0 WHERE n > 0),
d0 AS (SELECT domain, d.suffix, d.n, d.bad, (s0.bad - d.bad + ks.k * s0.up) / (s0.n - d.n + ks.k) AS up FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM un GROUP BY 1, 2) d JOIN s0 ON s0.suffix = d.suffix, ks), kd AS (SELECT {k} AS k FROM d0 WHERE n > 0),
h0 AS (SELECT host, un.n, un.bad, (d0.bad - un.bad + kd.k * d0.up) / (d0.n - un.n + kd.k) AS up FROM un JOIN d0 ON d0.domain = un.domain, kd), kh AS (SELECT {k} AS k FROM h0 WHERE n > 0),
m AS (SELECT host, bad + k * up AS a, n + k - (bad + k * up) AS b FROM h0, kh), m2 AS (SELECT *, cbrt(b / a) AS r FROM m), low AS (SELECT host, (1 - 1 / (9 * a) - r * (1 - 1 / (9 * b))) / sqrt(1 / (9 * a) + r * r / (9 * b)) AS above FROM m2)""".replace(
    "{k}", "greatest(1.0, least(200.0, coalesce(1 / CASE WHEN rho > 0 THEN rho END - 1, 200.0)))"
).replace("{suffixes}", ", ".join(f"'{s}'" for s in SUFFIXES))


def _with_rho(sql: str) -> str:
    """Puts the moment estimate where a strength is asked for."""
    rho = "(sum(n * pow(bad / n - up, 2)) - sum(up * (1 - up))) / nullif(sum((n - 1) * up * (1 - up)), 0)"
    return sql.replace("rho", f"({rho})")


#: The register of crc32 after each byte, and the crc32 of the UTF-8 bytes of {text}.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t)"


def _crc32(text: str) -> str:
    """The crc32 of a text's UTF-8 bytes, as SQL beside the table ``crc``."""
    octets = f"list_transform(range(0, len(hex(encode({text}))), 2), lambda i: CAST('0x' || hex(encode({text}))[i + 1:i + 2] AS BIGINT))"
    return f"xor(4294967295, list_reduce([4294967295] || {octets}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


#: All runs of one to three words of the list w.
_RUNS = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"

#: A bucket's features, of a table of bucketed runs.
_SIDE = "SELECT bucket, CAST(sum(n) AS DOUBLE) AS n FROM {of} JOIN buckets USING (s) GROUP BY bucket"

#: The cheapest way to each grammar state after each row: v0 to v3, with inserts before them c2 and c3.
def _way(v: str, letter: str, cost: object) -> str:
    return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}'}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_KEEP = "CASE WHEN lower(code) = '{}' THEN late ELSE 1000000 END"
_REROLE = "CASE WHEN code = 'd' THEN 1000000 ELSE 3 + late END"


def _inserted(of: str) -> str:
    return f"""(SELECT *, {_least("v3", _way("c2", "I", 3))} AS c3 FROM (SELECT *, {_least("v2", _way("v0", "I", 3), _way("v1", "I", 3), _way("v3", "I", 3))} AS c2 FROM {of}))"""



_STEP = ", ".join((
    _way("v0", "D", 4),
    _least(_way("v1", "D", 4), _way("v0", "K", _KEEP.format("s"))),
    _least(_way("c2", "D", 4), *(_way(v, "K", _KEEP.format("u")) for v in ("v0", "v1", "c3")), *(_way(v, "R", _REROLE) for v in ("v0", "v1", "c3"))),
    _least(_way("c3", "D", 4), _way("c2", "K", _KEEP.format("a")), _way("c2", "R", _REROLE)),
))
_NONE = "{'c': 1000000, 'a': ''}"
_FULL = r"[^\x20\x09-\x0D]"

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), []) AS w FROM documents), sh AS (SELECT DISTINCT doc_id, unnest({_shingles("w", 4)}) AS s FROM w), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS t FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.t)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT d, min(t) AS component_id FROM r GROUP BY d) c ON c.d = documents.doc_id""",
    "op4_url_filter": f"""WITH {_with_rho(_URLS)}, rules AS (SELECT * FROM (VALUES {_RULES}) AS t(h, p, v)),
f AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p DESC) AS rn FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, CASE WHEN above > 1.645 THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND rn = 1 JOIN low ON low.host = u.host""",
    "op6_source_mixing": f"""WITH RECURSIVE n AS (SELECT doc_id, source, CAST(len(coalesce(regexp_extract_all(text, '{_WORD}'), [])) AS BIGINT) AS size, (CAST('0x' || substr(md5('mix-' || doc_id), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
d AS (SELECT *, (length(bin(size)) - 1) * 4 + ((size * 4) >> CAST(length(bin(size)) - 1 AS BIGINT)) % 4 AS layer FROM n),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size) * 2e0 AS cap, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM d GROUP BY source),
v AS (SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER q, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS level FROM s WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT arg_min(level, cap / w) AS level FROM v WHERE cap / w > level), t AS (SELECT source, source_size, least(cap, coalesce(z.level * w, cap)) AS target FROM s LEFT JOIN z ON true),
g AS (SELECT *, CAST(floor(target / source_size) AS BIGINT) AS whole, target / source_size - floor(target / source_size) AS p, (CAST('0x' || substr(md5('mix-source-' || coalesce(source, 'null')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS start FROM t WHERE source_size > 0),
l AS (SELECT g.source, p, start, layer, CAST(count(*) AS DOUBLE) AS many, CAST(sum(size) AS DOUBLE) AS total, CAST(sum(size * size) AS DOUBLE) AS square, CAST(min(size) + max(size) AS DOUBLE) AS ends, row_number() OVER (PARTITION BY g.source ORDER BY layer DESC) AS k FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source WHERE size > 0 GROUP BY g.source, p, start, layer),
f AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS layer, 0e0 AS n, 0e0 AS many, 0e0 AS total, 0e0 AS ends, 0e0 AS cum, 0e0 AS words FROM g UNION ALL
SELECT source, k, layer, n, many, total, ends, cum, words + CASE WHEN 2 * n <= many THEN n * square / total ELSE total - (many - n) * (ends * total - square) / (many * ends - total) END
FROM (SELECT f.source, l.k, l.layer, greatest(0e0, least(l.many, floor((l.p * (f.cum + l.total) - f.words) * l.many / l.total + l.start))) AS n, l.many, l.total, l.square, l.ends, f.cum + l.total AS cum, f.words FROM f JOIN l ON l.source IS NOT DISTINCT FROM f.source AND l.k = f.k + 1)),
o AS (SELECT *, (u / (1 - u)) / (pi / (1 - pi)) AS x FROM (SELECT d.*, n, CASE WHEN 2 * n <= many THEN n * size / total ELSE 1 - (many - n) * (ends - size) / (many * ends - total) END AS pi FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.layer = d.layer WHERE size > 0 AND n > 0 AND n < many)),
m AS (SELECT doc_id FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY source, layer ORDER BY x / (1 + x), u, doc_id, size) AS place FROM o) WHERE place <= n UNION ALL SELECT doc_id FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.layer = d.layer WHERE size > 0 AND n >= many)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(g.whole + CAST(m.doc_id IS NOT NULL AS INT), 0) * d.size AS BIGINT) AS taken FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN g ON g.source IS NOT DISTINCT FROM d.source LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op11_importance_resampling": f"""WITH {_CRC_TABLE}, w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
bw AS (SELECT coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
runs AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest({_RUNS}) AS s FROM w) GROUP BY ALL), wanted AS (SELECT s, count(*) AS n FROM (SELECT unnest({_RUNS}) AS s FROM bw) GROUP BY ALL),
buckets AS (SELECT s, {_crc32("s")} % 10000 AS bucket FROM (SELECT s FROM runs UNION SELECT s FROM wanted), crc),
a AS ({_SIDE.format(of="runs")}), b AS ({_SIDE.format(of="wanted")}), g AS (SELECT bucket, CAST(floor(1000e0 * ln((coalesce(b.n, 0) + 1e0) * ((SELECT coalesce(sum(n), 0) FROM a) + 1e4) / ((coalesce(a.n, 0) + 1e0) * ((SELECT coalesce(sum(n), 0) FROM b) + 1e4)))) AS BIGINT) AS gain FROM a FULL JOIN b USING (bucket)),
d AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM runs JOIN buckets USING (s) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000e0 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM w LEFT JOIN d ON d.doc_id = w.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r ON r.doc_id = x.doc_id""",
    "op13_conversation_repair": f"""WITH RECURSIVE {_CRC_TABLE}, k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
f AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, NOT regexp_matches(text, '{_FULL}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM d),
g AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN seen THEN 'duplicate' WHEN cut THEN 'truncated' END AS fault, CASE WHEN blank OR seen THEN 'd' WHEN cut THEN CASE WHEN initial IN ('s', 'u', 'a') THEN upper(initial) ELSE 'X' END WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS code, CASE WHEN cut THEN 3 ELSE 0 END AS late, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': ''}} AS v0, {_NONE} AS v1, {_NONE} AS v2, {_NONE} AS v3 FROM c UNION ALL
SELECT conv_id, i + 1, s[1], s[2], s[3], s[4] FROM (SELECT q.conv_id, q.i, [{_STEP}] AS s FROM {_inserted("r")} q JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i + 1)),
z AS (SELECT conv_id, {_least("v0", "c3")} AS z FROM {_inserted("(SELECT * FROM r QUALIFY i = max(i) OVER (PARTITION BY conv_id))")}),
e AS (SELECT *, count(*) FILTER (letter <> 'I') OVER o AS i, count(*) FILTER (letter <> 'D') OVER o AS place FROM (SELECT conv_id, unnest(string_split(z.a, '')) AS letter, unnest(range(length(z.a))) AS n FROM z WHERE z.a <> '') WINDOW o AS (PARTITION BY conv_id ORDER BY n)),
t AS (SELECT e.conv_id, n, letter, CAST(place AS INT) AS place, g.role, CASE WHEN letter = 'I' THEN '' ELSE g.text END AS text FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i WHERE letter <> 'D'),
y AS (SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM t),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY n)) AS repaired_sha256 FROM y GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(z.z.c, 0) AS BIGINT) AS cost, coalesce(z.z.a, '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op10_line_dedup": f"""WITH ln AS (SELECT doc_id, unnest(string_split({_LOWER}, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents), w AS (SELECT doc_id, no, doc_id * 1000000 + no AS id, regexp_extract_all(line, '{_WORD}') AS w FROM ln),
sh AS (SELECT DISTINCT id, doc_id, no, unnest({_shingles("w", 5)}) AS s FROM w), n AS (SELECT id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND b.id < a.id GROUP BY 1, 2), gone AS (SELECT DISTINCT a FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT a // 1000000 AS doc_id, count(*) AS n_removed, string_agg(CAST(a % 1000000 AS VARCHAR), ',' ORDER BY a) AS removed FROM gone GROUP BY 1)
SELECT documents.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id""",
}
