from __future__ import annotations

import random

from helpers import DOCS, components

from waymark.llm import ngram_jaccard_join as op


def run(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op.ngram_jaccard_join(df, **kw).collect()}


def near_copies(n, size, edits, seed):
    """Texts around one original, each with a few words changed, and chains of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    rows, last = [], base
    for i in range(n):
        own = list(last if i % 3 else base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(size)] = f"e{rng.randrange(10_000)}"
        last = own
        rows.append((i * 7 % n + 100, " ".join(own), "en", "a", 0))
    return rows


def test_same_components_as_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert run(docs) == components(rows)


def test_groups_of_near_copies(spark):
    rows = [r for s, (n, size, edits) in enumerate([(60, 40, 2), (40, 200, 6), (30, 900, 20), (30, 9, 1), (30, 5, 1)]) for r in near_copies(n, size, edits, s)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert run(spark.createDataFrame(rows, DOCS)) == components([r[:2] for r in rows])


def test_stars_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(op, "MAX_STARS", 2)
    monkeypatch.setattr(op, "SKETCH_WORDS", -1)
    rows = near_copies(60, 60, 3, 11)
    assert run(spark.createDataFrame(rows, DOCS)) == components([r[:2] for r in rows])


def test_nasty_rows(nasty):
    out = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in op.ngram_jaccard_join(nasty).collect())
    assert len(out) == 11
    assert [x for x in out if x[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [x for x in out if x[0] in (4, 5)] == [(4, 1, 4), (4, 1, 4), (5, 1, 4)]
    assert out[0] == (0, 1, None)
    assert [x[2] for x in out if x[0] in (6, 7)] == [6, 6]


def test_empty_table_and_extra_columns(spark, empty):
    assert op.ngram_jaccard_join(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 0, 0), (2, "A b c d e", 0, 0)], "doc_id int, text string, sid int, `key` int")
    assert run(df) == {1: (2, 1), 2: (2, 1)}


def test_near_copies_that_do_not_link_are_told_apart_in_the_join(spark, monkeypatch):
    rng, rows = random.Random(4), []
    base = [f"w{i}" for i in range(403)]
    for i in range(60):
        own = list(base)
        for p in rng.sample(range(5, 395, 6), 6):
            own[p] = f"e{i}x{p}"
        rows.append((i, " ".join(own), "en", "a", 0))
    asked, own = [], op.verified
    monkeypatch.setattr(op, "verified", lambda pairs, *more: asked.append(pairs.count()) or own(pairs, *more))
    assert run(spark.createDataFrame(rows, DOCS)) == components([r[:2] for r in rows])
    # of 1,770 pairs at the last turn
    assert asked[-1] <= 100, asked
