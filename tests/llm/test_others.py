from __future__ import annotations

import functools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, later_lines, words
from pyspark.sql import functions as F

from waymark.llm import common, decontamination, html_extraction, kernel, language_id, line_dedup, mixing, nearest, quality, sharding, url_filter
from waymark.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"


# language id


def test_languages_of_held_out_rows(spark, docs):
    out = QUERIES["op1_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_cases(spark, docs, nasty, empty):
    model = language_id.fit(docs, ~language_id.held_out(docs))
    got = {r["doc_id"]: (r["lang_pred_"], r["score"]) for r in language_id.identify(nasty.withColumnRenamed("source", "LANG_PRED"), model).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0) and got[9][0] in {"en", "de", "fr", "es"} and 0 <= got[6][1] <= 1
    none = language_id.fit(empty, ~language_id.held_out(empty))
    assert {r["lang_pred"] for r in language_id.identify(nasty, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    one = language_id.fit(docs.where("lang = 'de'"), ~language_id.held_out(docs))
    assert {r["lang_pred"] for r in language_id.identify(docs, one).collect()} == {"de"}


# decontamination


def holding(docs, items):
    flat = [(i, b" ".join(words(t))) for i, t in items if words(t)]
    return {(d, i) for d, t in docs for i, f in flat if f in b" ".join(words(t))}


def test_leaks_are_found(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(docs, bench).collect()}
    want = holding([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert want and got == want
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_wand_gives_what_scoring_all_gives():
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"t{rng.zipf(1.3) % 60}" for _ in range(rng.integers(1, 15)))) for i in range(70)]
    index = decontamination.build(items)
    for _ in range(60):
        terms = np.unique(rng.integers(0, len(index.vocab), 12))
        score = np.zeros(len(index.ids))
        for t in terms:
            own = slice(index.begin[t], index.begin[t + 1])
            score[index.item[own]] += index.impact[own]
        for least in (0.1, 0.4, 0.8):
            got = dict(decontamination.block_max_wand(index, terms, least))
            assert set(got) == set(np.flatnonzero(score >= least).tolist()) or np.any(np.abs(score - least) < 1e-12)
            assert all(abs(score[i] - s) < 1e-12 for i, s in got.items())


def test_scores_do_not_depend_on_the_shard(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(5)
    items = spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(60)], "item_id long, text string")
    texts = [(100 + i, "start " + r["text"] + " end") for i, r in enumerate(items.collect())]
    held = spark.createDataFrame(texts, "doc_id long, text string")
    whole = sorted(map(tuple, decontamination.contaminations(held, items).collect()))
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 8)
    monkeypatch.setattr(decontamination, "SHARDS_A_PASS", 3)
    parts = sorted(map(tuple, decontamination.contaminations(held, items).collect()))
    assert [x[:2] for x in parts] == [x[:2] for x in whole] and {(100 + i, i) for i in range(60)} <= {x[:2] for x in whole}
    assert all(math.isclose(a[2], b[2], rel_tol=1e-12) for a, b in zip(parts, whole, strict=True))


def test_a_long_item_in_the_shard_changes_nothing(spark, monkeypatch):
    item = [f"q{i}" for i in range(20)]
    # pieces of eight words of the item, 200 words apart: no passage of its own length holds it
    spread = " ".join([*item[:8], *["pad"] * 200, *item[6:14], *["pad"] * 200, *item[12:]])
    whole = " ".join(["pad"] * 70 + item + ["pad"] * 70)
    rng = random.Random(8)
    docs = spark.createDataFrame([(1, spread), (2, whole)], "doc_id long, text string")
    long = " ".join(f"z{rng.randrange(10**6)}" for _ in range(3000))
    for items in ([(1, " ".join(item))], [(1, " ".join(item)), (2, long)]):
        got = decontamination.contaminations(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(2, 1)]
    # items of mixed lengths give the same in shards of any size, and with bounds in small groups
    words = [f"w{i}" for i in range(300)]
    mixed = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 7, 8, 15, 16, 40, 200])))) for i in range(50)]
    frame = spark.createDataFrame(mixed, "item_id long, text string")
    held = spark.createDataFrame([(i, " ".join([t, *rng.choices(words, k=300), mixed[(i + 7) % 50][1]])) for i, t in mixed], "doc_id long, text string")
    first = sorted(tuple(r)[:2] for r in decontamination.contaminations(held, frame).collect())
    assert {(i, i) for i, _ in mixed} <= set(first)
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 6)
    monkeypatch.setattr(decontamination, "SHARDS_A_PASS", 4)
    assert sorted(tuple(r)[:2] for r in decontamination.contaminations(held, frame).collect()) == first


def test_passages_in_groups(monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(30)]
    shard = decontamination.build_shard(items)
    text = " ".join([*rng.choices(words, k=400), items[3][1], *rng.choices(words, k=400), items[20][1]])
    data, at = kernel.buffers(pa.array(["", text, items[7][1]]))
    found = decontamination.search(shard, kernel.Words(data, at), at, 0.5, 0.8)
    monkeypatch.setattr(decontamination, "BOUNDS", 1)
    assert decontamination.search(shard, kernel.Words(data, at), at, 0.5, 0.8) == found
    assert {(1, 3), (1, 20), (2, 7)} <= {x[:2] for x in found}


@pytest.mark.parametrize("rows", [1, 399, 10**6, 10**9, 10**12, 10**15])
def test_a_sample_is_drawn_from_any_number_of_rows(spark, rows):
    bound = common.draw_bound(520, rows)
    assert 0 < bound <= 1 << 62 and abs(bound / 2**62 * rows - min(rows, 520)) < 0.01
    assert spark.range(1000).where(common.draw("id", seed=17) < common.draw_bound(1000, 1000)).count() == 1000


def test_leaks_anywhere_in_long_texts_and_edge_items(spark, nasty, empty):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(i, " ".join(["pad"] * (i * 37) + [item] + ["end"] * 500), "en", "a", 0) for i in range(8)]
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "single")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == {(i, j) for i in range(8) for j in (1, 2)}
    assert decontamination.contaminations(nasty, bench).count() == 0
    assert decontamination.contaminations(nasty, bench.where("item_id = 4")).count() == 0
    assert decontamination.contaminations(empty, bench).count() == 0 and decontamination.decontaminate(nasty, bench).count() == nasty.count()


def test_edited_and_glued_leaks(spark):
    item = [f"q{i}" for i in range(15)]
    edited = [item[:i] + ["other"] + item[i + 1 :] for i in range(15)]
    glued = [[*item[:-1], item[-1] + ".%%%"], ["((" + item[0], *item[1:]], ["((" + item[0], *item[1:-1], item[-1] + "%"]]
    parted = [item[:11], item[:11] + ["x", "y", "z"], item[4:11], item[::2], item[::-1]]  # without the answer, or without its order
    rows = [(i, " ".join(["pad"] * 50 + w + ["end"] * 50), "en", "a", 0) for i, w in enumerate(edited + glued + parted)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "who was the first Ada")], "item_id long, text string")
    rows += [(100, "they asked who was the first and went on", "en", "a", 0), (101, "they asked who was the first Ada and went on", "en", "a", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(frame, bench).collect()}
    assert got == {(i, 1) for i in range(18)} | {(101, 2)}
    assert {r["doc_id"] for r in decontamination.decontaminate(frame, bench).collect()} == {*range(18, 23), 100}


# URL filter


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "x://y", "ftp://h.net#/de/", "http://example.net/de/81", "http://user@b.org:80/es/1?x://z/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([], "url string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, outcomes, URL_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 3: ("example.com", "/en/8", "com/en/", "block"),
        4: ("y", "", None, "allow"), 5: ("h.net", "", None, "allow"), 6: ("example.net", "/de/81", "example.net/de/8", "block"), 7: ("user@b.org:80", "/es/1", None, "allow"),
    }


def test_rules_are_those_of_the_contract(spark):
    """Each rule's word, also against a reputation that says the opposite."""
    assert URL_RULES == (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
    outcomes = spark.createDataFrame([("http://bad.net/", 1)] * 60, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://bad.net/de/1"), (2, "http://a.example.net/de/8"), (3, "http://bad.net/fr/1")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, outcomes, URL_RULES).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: (None, "block")}


def test_bad_hosts_are_blocked_and_shrunk(spark):
    rows = [(f"http://bad.a.com/{i}", 1) for i in range(60)] + [(f"http://good{i % 9}.b.com/{i}", 0) for i in range(90)] + [("http://once.c.com/1", 1)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://bad.a.com/x"), (2, "http://good1.b.com/"), (3, "http://once.c.com/2"), (4, "http://new.b.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, outcomes, ()).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    assert url_filter.judge_urls(pages.where("page_id < 0"), outcomes, ()).count() == 0


# sharding


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com": ("example.com", "com"), "u@10.0.0.1:80": ("10.0.0.1", "[address]"), "[::1]:8080": ("[::1]", "[address]"), "host": ("host", "host"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: (r["d"], r["s"]) for r in rows.select("host", url_filter.domain_of(F.col("host")).alias("d"), url_filter.suffix_of(F.col("host")).alias("s")).collect()} == hosts


def test_posterior_quantile(spark):
    """Against a numeric integral of the beta density, over the logit, where it is smooth."""
    cases = [(a, b, x) for a in (0.5, 1.0, 2.5, 8.0, 60.0, 900.0) for b in (0.5, 1.0, 2.5, 8.0, 60.0, 900.0) for x in (0.2, 0.5, 0.8)]
    for x in (0.2, 0.5, 0.8):
        rows = spark.createDataFrame([c[:2] for c in cases if c[2] == x], "a double, b double")
        for r in rows.select("a", "b", url_filter.surely_above(F.col("a"), F.col("b"), x).alias("z")).collect():
            t = np.linspace(-80, 80, 400_001)
            log = -r["a"] * np.logaddexp(0, -t) - r["b"] * np.logaddexp(0, t)
            mass = np.exp(log - log.max())
            above = mass[t > math.log(x / (1 - x))].sum() / mass.sum()
            assert abs(0.5 * math.erfc(-r["z"] / math.sqrt(2)) - above) < 0.02, (r, x, above)


def test_url_repeats_nulls_and_clashes(spark):
    rows = [(1, "http://bad.a.com/x", "h", "r")] * 2 + [(2, None, None, None), (None, "http://good.b.com/", "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, above string")
    outcomes = spark.createDataFrame([("http://bad.a.com/", 1)] * 50 + [("http://good.b.com/", 0)] * 50 + [("http://good.b.com/", None), (None, 0)], "url string, bad int")
    got = sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in url_filter.judge_urls(pages, outcomes, ()).collect())
    assert got == [(0, "good.b.com", "allow"), (1, "bad.a.com", "block"), (1, "bad.a.com", "block"), (2, "", "allow")]


@pytest.mark.parametrize("shards", [16, 3])
def test_shards_are_even_gapless_and_keep_groups(spark, docs, shards):
    rows = sharding.shard_slots(docs, shards).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by, home = defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        by[r["shard"]].append(r)
        home[t].add(r["shard"])
    assert len(rows) == len(texts) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert all(len(x) == 1 for x in home.values())
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    assert max(sizes) - sum(sizes) / shards <= max(r["size"] for r in rows)
    assert {r["doc_id"]: r["shard"] for r in sharding.with_shards(docs, shards).collect()} == {r["doc_id"]: r["shard"] for r in rows}


def test_hot_text_is_subdivided_and_nasty_rows(spark, nasty, empty):
    rows = [(i, "same text" if i % 3 == 0 else f"other {i} text", "en", "a", 0) for i in range(3000)]
    got = sharding.shard_slots(spark.createDataFrame(rows, DOCS), 16).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 16 and max(sizes) < 1.1 * sum(sizes) / 16
    out = sharding.shard_slots(nasty).collect()
    assert len(out) == 11 and [(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 1] == [(1, None)]
    assert sharding.shard_slots(empty).count() == 0 and sharding.with_shards(empty).columns == [*empty.columns, "shard"]
    clash = sharding.with_shards(nasty.withColumnRenamed("source", "Shard").withColumnRenamed("lang", "key"))
    assert clash.count() == 11 and clash.columns[-1] == "shard_"


# mixing


def fill(sizes, weights, share, cap):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        for s in over or open_:
            out[s] = cap * sizes[s] if over else left * w[s] / total
        if not over:
            break
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def test_mix_meets_targets(spark, docs):
    big = docs.union(docs.selectExpr("doc_id + 1000", "concat(text, ' more')", "lang", "source", "n_chars"))
    rows = mixing.mix_sources(big).join(big.selectExpr("doc_id as d", "source", "text"), mixing.F.col("doc_id") == mixing.F.col("d")).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = fill(sizes, (5, 2, 1), 1.5, 2.0)
    for s in want:
        assert math.isclose(target[s], want[s], rel_tol=1e-12) and abs(taken[s] - want[s]) <= 0.1 * want[s]
    assert sum(r.n for r in mixing.mixed(big).groupBy("doc_id").agg(mixing.F.count("*").alias("n")).collect()) == sum(r["taken"] // r["size"] for r in rows)


def test_mix_cases(spark, nasty, empty):
    first = sorted(map(str, mixing.mix_sources(nasty).collect()))
    assert first == sorted(map(str, mixing.mix_sources(nasty.repartition(3)).collect())) and len(first) == 11
    rows = mixing.mix_sources(nasty).collect()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns
    assert mixing.mixed(nasty.withColumnRenamed("lang", "p").withColumnRenamed("n_chars", "step")).count() >= 0


def pareto(rows, seed="mix", weights=(5, 2, 1), share=1.5, cap=2.0):
    """({doc_id: words taken}, {doc_id: inclusion probability}) by a plain loop over sources and layers."""
    import hashlib

    draw = lambda x: (int(hashlib.md5(f"{seed}-{x}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    sizes, own, out, chance = defaultdict(int), defaultdict(lambda: defaultdict(list)), {}, {}
    for d, t, s in rows:
        n = len(words(t))
        sizes[s] += n
        out[d] = 0
        if n:
            e = n.bit_length() - 1
            own[s][e, (n * 4 >> e) % 4].append((d, n))
    for s, target in fill(sizes, weights, share, cap).items():
        if not sizes[s]:
            continue
        whole, cum, expected, start = math.floor(target / sizes[s]), 0.0, 0.0, draw(f"source-{s}" if s is not None else "source-null")
        p = target / sizes[s] - whole
        for _, layer in sorted(own[s].items(), reverse=True):
            many, total = len(layer), float(sum(n for _, n in layer))
            ends = min(n for _, n in layer) + max(n for _, n in layer)
            cum += total
            k = max(0, min(many, math.floor((p * cum - expected) * many / total + start)))
            pi = {d: k * n / total if 2 * k <= many else 1 - (many - k) * (ends - n) / (many * ends - total) for d, n in layer}
            expected += sum(pi[d] * n for d, n in layer)
            ranked = layer if k in (0, many) else sorted(layer, key=lambda x: draw(x[0]) / (1 - draw(x[0])) / (pi[x[0]] / (1 - pi[x[0]])))
            for i, (d, n) in enumerate(ranked):
                out[d], chance[d] = (whole + (i < k)) * n, pi[d]
    return out, chance


def test_mix_is_a_pareto_sample(spark, docs):
    huge = docs.union(spark.createDataFrame([(9000 + i, "word " * n, "en", "src5", 0) for i, n in enumerate((9000, 3000, 1500))] + [(9500 + i, "w " * (40 + i % 9), "en", None, 0) for i in range(300)], DOCS))
    for table, seed in ((docs, "mix"), (huge, "mix"), (huge, "again")):
        want, _ = pareto([tuple(r) for r in table.select("doc_id", "text", "source").collect()], seed)
        assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(table, seed=seed).collect()} == want


def test_inclusion_frequencies_over_many_seeds():
    """The twin's inclusions agree with its probabilities, which differ by document and sum to the layer's number."""
    rows = [(i, "w " * n, "a" if i % 2 else "b") for i, n in enumerate([33, 35, 36, 38, 39] * 12 + [65, 70, 75, 79] * 6 + [300, 5, 2])]
    seen, want, times = defaultdict(float), defaultdict(float), 1000
    whole = {s: math.floor(t / sum(len(words(x)) for _, x, y in rows if y == s)) for s, t in fill({s: sum(len(words(x)) for _, x, y in rows if y == s) for s in "ab"}, (5, 2, 1), 1.5, 2.0).items()}
    for i in range(times):
        taken, chance = pareto(rows, f"s{i}")
        for d, t, s in rows:
            seen[d] += taken[d] / len(words(t)) - whole[s]
            want[d] += chance[d]
    assert len({round(x, 1) for x in want.values()}) > 5
    for d in want:
        p = want[d] / times
        assert abs(seen[d] / times - p) < 4.5 * math.sqrt(max(p * (1 - p), 1e-3) / times) + 0.01


# HTML


PAGE = "<html><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>First <b>bold\n one<br>x<p>Second &lt;p&gt; part</article><div class=comments><p>I agree</p></div><footer>&copy; h</footer><script>var t='</p>';</script>"


def test_article_of_single_pages():
    assert html_extraction.extract(PAGE, None) == "Head & line\n\nFirst bold one x\n\nSecond <p> part"
    for empty_page in (None, "", "<nav>x</nav>", "<!-- <p>no</p>", "<script>x"):
        assert html_extraction.extract(empty_page, None) == ""
    plain = "<body><div id=menu><ul><li><a>a</a></ul></div><div class=wrap><p>Text of some length here.</p><p>And more of it 1 < 2.</p></div><div class='cookie-notice'>We use cookies</div></body>"
    assert html_extraction.extract(plain, None) == "Text of some length here.\n\nAnd more of it 1 < 2."


@pytest.mark.parametrize("names", ["content has-sidebar", "layout-sidebar-right", "post no-comments", "sidebar"])
def test_wrappers_named_after_other_parts(names):
    inner = "<article><div class='entry-header'><h1>Head</h1><p class=byline>By A B</p></div><p>Text of some length here.</p><div class='related-posts'>More</div></article>"
    page = f"<body><div class=page><div class='{names}'>{inner}</div><div class='left-sidebar'>Side</div><div class='comments-area'><p>I agree</p></div></div></body>"
    assert html_extraction.extract(page, None) == "Head\n\nBy A B\n\nText of some length here."
    plain = f"<body><div class='{names}'><div class='post-header'><h1>Head</h1></div><p>Text of some length here.</p></div><div class='main-nav'>Nav</div></body>"
    assert html_extraction.extract(plain, None) == "Head\n\nText of some length here."


def test_comments_longer_than_the_article_stay_out():
    page = f"<body><article><h1>Head</h1><p>Short.</p></article><div id=comments>{'<div class=comment><p>I agree with all of this.</p></div>' * 20}</div></body>"
    assert html_extraction.extract(page, None) == "Head\n\nShort."


def test_article_of_links():
    page = "<body><nav><a href=x>Menu</a></nav><article><p><a href=x>All of this text is a link</a></p><p>and <a href=y>most of this one too</a></p></article></body>"
    assert html_extraction.extract(page, None) == "All of this text is a link\n\nand most of this one too"


def test_wrapper_groups():
    trees = [html_extraction.tree_of(html_extraction.blocks_of(f"<body><div><h2>t{i}</h2><p>a{i}</p>{'<p>b</p>' * i}</div>{'<table><tr><td>x</td></tr></table>' if i else ''}</body>")) for i in range(3)]
    w = html_extraction.align(html_extraction.align(trees[0], trees[1]), trees[2])
    assert "h2(#)" in html_extraction.expression(w) and "p(#)+" in html_extraction.expression(w) and "table(" in html_extraction.expression(w) and "?" in html_extraction.expression(w)



def test_wrapper_repeats_squares_in_order():
    trees = [html_extraction.tree_of(html_extraction.blocks_of(p)) for p in ("<h2>a</h2><p>b</p><div>c</div><h2>d</h2>", "<h2>x</h2><p>y</p><h2>a</h2><p>z</p><div>c</div><h2>d</h2>")]
    for w in (html_extraction.align(*trees), html_extraction.align(*trees[::-1])):
        assert html_extraction.expression(w) == "((h2(#) p(#))+ div(') h2('))"
        assert html_extraction.matches(w, "<h2>a</h2><p>b</p>" * 5 + "<div>c</div><h2>d</h2>")
        assert not html_extraction.matches(w, "<h2>a</h2><p>b</p><h2>d</h2><div>c</div>")


def random_page(r, depth=2):
    out = ""
    for _ in range(r.choice([0, 1, 2, 3, 5, 8, 70 if r.random() < 0.1 else 4])):
        tag = r.choice(["p", "h2", "div", "div", "section", "#"])
        names = r.choice(["", " class=a", " class=b"])
        out += r.choice(["x", "y z"]) + " " if tag == "#" else f"<{tag}{names}>{random_page(r, depth - 1)}</{tag}>" if depth and tag in ("div", "section") else f"<{tag}>w{r.randrange(3)}</{tag}>"
    return out


@pytest.mark.parametrize("seed", range(200))
def test_pages_match_their_wrapper(seed):
    r = random.Random(seed)
    pages = [f"<html><body>{random_page(r)}</body></html>" for _ in range(r.randint(1, 6))]
    trees = [html_extraction.tree_of(html_extraction.blocks_of(p)) for p in pages]
    half = len(trees) // 2 if seed % 2 else 0
    w = functools.reduce(html_extraction.align, trees[half:])
    if half:
        w = html_extraction.align(functools.reduce(html_extraction.align, trees[:half]), w)
    assert all(html_extraction.matches(w, p) for p in pages)
    rule = html_extraction.decision(w)
    assert all(isinstance(html_extraction.extract(p, rule), str) for p in pages)


def test_wrapper_alone_finds_the_article(spark):
    """Only div and no names: what differs from page to page is the article."""

    def page(i):
        return f"<div><div>Daily news of the town and its harbour</div><div>All sections at a glance</div></div><div><div>Title {i}</div>{''.join(f'<div>Part {j} of text {i}</div>' for j in range(i % 3 + 1))}</div><div>Imprint and contact of the house</div>"

    pages = spark.createDataFrame([(i, f"http://plain/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.main_texts(pages).collect()}
    assert got == {i: "\n\n".join([f"Title {i}", *(f"Part {j} of text {i}" for j in range(i % 3 + 1))]) for i in range(6)}
    assert "Imprint" in html_extraction.extract(page(0), None)  # one page alone does not tell


def test_html_cases(spark):
    schema = "page_id long, url string, html string, text string, host string, rule string"
    assert html_extraction.main_texts(spark.createDataFrame([], schema)).collect() == []
    deep = "<div>" * 3000 + "<p>Deep text</p>" + "</div>" * 3000
    long = "<article>" + "<p>word and word</p><h2>head</h2>" * 20_000 + "</article>"
    rows = [(1, "http://h/1", PAGE, "t", "u", "v")] * 2 + [(2, "http://deep/", deep, None, None, None), (3, "http://long/", long, None, None, None), (4, None, None, None, None, None)]
    got = sorted((r["page_id"], r["n_chars"], r["text"]) for r in html_extraction.main_texts(spark.createDataFrame(rows, schema)).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[0] == got[1] and got[2][2] == "Deep text" and got[4][2] == ""
    assert got[3][2] == "\n\n".join(["word and word", "head"] * 20_000)


def test_constant_notice_without_a_class_is_template(spark):
    page = lambda i: f"<body><div><p>{' '.join(f'word{i}{j}' for j in range(30))}</p><p>tail {i}</p></div><div><span>Always the same words stand at the end of this page here</span></div></body>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(8)] + [(99, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.main_texts(pages).collect()}
    assert got[99] == "" and all("Always" not in got[i] and got[i].endswith(f"tail {i}") for i in range(8))


def test_titles_of_equal_length_and_start_are_no_template(spark):
    page = lambda i: f"<body><div><h2>Weekly market report of 2024-01-{i + 10}</h2><p>{' '.join(f'word{i}{j}' for j in range(30))}</p></div></body>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert all(r["text"].startswith(f"Weekly market report of 2024-01-{r['page_id'] + 10}\n\nword") for r in html_extraction.main_texts(pages).collect())


def test_pages_against_their_articles(spark):
    import html
    import re

    rows = html_extraction.main_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# quality


def auc(y, s):
    good, bad = [x for x, q in zip(s, y, strict=True) if q], [x for x, q in zip(s, y, strict=True) if not q]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES["op8_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([r["quality"] for r in rows], [r["score"] for r in rows]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_cases(spark, nasty, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(nasty, labels).count() == 11
    assert {r["score"] for r in quality.quality_scores(nasty, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


# nearest neighbours


def exact(rows, every, k):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        o = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in o]
    return out


def test_recall_and_distances(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in table.collect()], 10, 10)
    got = defaultdict(list)
    for r in nearest.nearest(table, every=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    known = {q: dict(exact([(r["vec_id"], r["embedding"]) for r in table.collect()], 10, 10**6)[q]) for q in list(want)[:3]}
    assert all(abs(s - known[q][i]) < 1e-12 for q in known for i, s in got[q])


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0], 0), (9, [], 0), (8, [0.0, 1.0], 0), (None, [1.0, 1.0], 0), (100, [1.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, math.sqrt(2)), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, math.sqrt(2))]
    assert nearest.nearest(table.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_the_index_alone_finds_the_neighbours(spark, n):
    """Recall of the whole query, and the share of pairs that the leaves verify, at sizes below and above the sample's."""
    rng = np.random.default_rng(n)
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    base = np.stack(own["embedding"].to_numpy()).astype(float)
    vectors = base[:n] if n <= len(base) else np.concatenate([base, base[rng.integers(0, len(base), n - len(base))] + rng.normal(0, 0.7, (n - len(base), base.shape[1])) * base.std(0)])
    ids, every = np.arange(n), max(10, n // 60)
    table = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(list(vectors))}))
    got = defaultdict(set)
    for r in nearest.nearest(table, every=every).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in ids[ids % every == 0]:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * sum(map(len, got.values())) and all(len(x) == 10 for x in got.values())
    asked, sampled = np.flatnonzero(ids % every == 0), rng.permutation(n)[: n // 8]
    points = vectors @ nearest.directions(vectors.shape[1], 16, 1)
    tried = 0
    q, _, d = nearest.first_found(ids[sampled], vectors[sampled], asked, vectors[asked], 10)
    for s in range(0, n, nearest.BLOCK):
        order, edges, _, _ = nearest.tree_of(points[s : s + nearest.BLOCK])
        order = order + s
        tried += nearest.search_leaves(ids[order], vectors[order], points[order], edges, asked, vectors[asked], nearest.bounds_of(len(asked), q, d, 10), 10, 0.95, 1)[3]
    share = tried / (n * len(asked))
    print(f"{n} rows: recall {hits / sum(map(len, got.values())):.3f}, {share:.2f} of pairs verified")
    assert share < 0.85


def test_the_least_vector_of_a_repeated_id_asks(spark):
    rows = [(0, [5.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [5.0, 1.0]), (3, [9.0, 9.0])]
    for n in (1, 5):
        table = spark.createDataFrame(rows[::-1] if n == 1 else rows, "vec_id long, embedding array<double>").repartition(n)
        assert [(r["vec_id"], r["score"]) for r in nearest.nearest(table, k=1).collect()] == [(1, 1.0)]


def test_lengths_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 0.5), (0, [1.0, 0.0], 1, 0.5), (1, [1.0, 1.0], 1, 0.5), (1, [1.0, 1.0], 2, 0.1), (2, [1.0], 0, 0.0), (100, [3.0], 0, 0.0), (3, [5.0], 0, 0.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, Rank int, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (100, 1, 2, 2.0), (100, 2, 3, 2.0)]


def test_chi_square():
    assert abs(float(nearest.chi_square_cdf(np.array(15.507313055865453), 8)) - 0.95) < 1e-9
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507313055865453) < 1e-6


# lines


def test_lines_are_removed_as_by_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(docs).collect() if r["n_removed"]}
    assert got and got == later_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in rows:
        assert kept[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(got.get(d, [])))


@pytest.mark.parametrize("stars", [0, 2])
def test_edited_lines(spark, monkeypatch, stars):
    import random

    rng = random.Random(stars)
    base = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (5, 8, 9, 14, 30, 60, 120)]
    rows = []
    for i in range(60):
        lines = []
        for b in base:
            own = list(b)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(50)}"
            lines.append(" ".join(own))
        rows.append((i, "\n".join(lines), "en", "a", 0))
    if stars:
        monkeypatch.setattr(line_dedup, "MAX_STARS", stars)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(spark.createDataFrame(rows, DOCS)).collect() if r["n_removed"]}
    assert got == later_lines([r[:2] for r in rows])


def test_line_cases(spark, nasty, empty):
    out = {(r["doc_id"], r["n_lines"]): r["removed"] for r in line_dedup.removed_lines(nasty).collect()}
    assert out[1, 0] == [] and out[2, 1] == [] and out[3, 2] == [] and out[None, 1] == [] and out[4, 1] == [0] and out[5, 1] == [0] and out[7, 1] == [0]
    assert line_dedup.removed_lines(nasty).count() == 11 and line_dedup.removed_lines(empty).count() == 0
    clash = nasty.withColumnRenamed("lang", "th").withColumnRenamed("source", "removed")
    assert line_dedup.dedup_lines(clash).columns == clash.columns and line_dedup.dedup_lines(clash).count() == 11
