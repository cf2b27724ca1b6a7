from __future__ import annotations

import pytest
from helpers import DOCS, components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, docs):
    frame, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        frame = spark.createDataFrame(rows, out.schema)
        seen.append(len(rows))
    assert seen[1] <= seen[0] and seen[2] < seen[1] and seen[3] < seen[2] and seen[4] > seen[3] and seen[5] == seen[4]


def test_one_of_each_group_stays(spark, docs):
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    groups = components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept == sorted(d for d, (_, c) in groups.items() if c == d)


def test_near_copies_by_five_words_and_four_fifths(spark, docs):
    base = [f"w{i}" for i in range(100)]
    edited = [f"e{w}" if i in (30, 60) else w for i, w in enumerate(base)]  # 0.848 of four words, 0.811 of five
    extra = spark.createDataFrame([(9001, " ".join(base), "en", "a", 0), (9002, " ".join(edited), "en", "a", 0)], DOCS)
    both = docs.union(extra)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, both, SF).collect())
    groups = components([(r["doc_id"], r["text"]) for r in both.collect()], k=5, num=80)
    assert 9001 in kept and 9002 not in kept and kept == sorted(d for d, (_, c) in groups.items() if c == d)


def test_only_linked_texts_of_a_repeated_id_go(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (1, b), (1, ""), (2, b), (2, c), (3, d), (3, d), (4, a + " z"), (4, c), (5, None)]
    frame = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect())
    assert got == [(1, ""), (1, a), (1, b), (2, c), (3, d), (5, "")]


def test_nasty_rows_pass_all_stages(spark, nasty, empty):
    for start in (nasty, empty):
        frame = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            frame = spark.createDataFrame(out.collect(), out.schema)
        assert frame.columns == [*start.columns, "shard"]
    two = corpus_pipeline.near_duplicates(spark, nasty, SF)
    assert sorted(r["doc_id"] or 0 for r in two.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]


def test_recognised_documents_stay(spark, docs):
    extra = spark.createDataFrame([(9001, "12 34 !!", "en", "a", 8), (9002, None, "en", "a", 0)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(extra), SF).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
