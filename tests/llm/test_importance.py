from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import DOCS
from pyspark.sql import functions as F

from waymark.llm import importance
from waymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of each row, by plain counting."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    every, wanted = Counter(bucket(f) for _, t in rows for f in features(t)[1]), Counter(bucket(f) for t in target for f in features(t)[1])
    n, m = sum(every.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (n + 10_000) / ((every[b] + 1) * (m + 10_000))))
    out = []
    for d, t in rows:
        k, own = features(t)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, k, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    ranks = []
    for i, r in enumerate(able[: len(able) * percent // 100]):
        ranks.append((*r[:1], *r[2:], i + 1))
        drawn[r] += 1
    for r in out:
        if drawn[r]:
            drawn[r] -= 1
        else:
            ranks.append((*r[:1], *r[2:], None))
    return sorted(ranks, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_matches_plain_counting(spark, docs):
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], bench)
    assert rows_of(QUERIES["op11_importance_resampling"](spark, SF)) == want and any(r[4] for r in want)


def test_cases(spark, nasty, empty):
    clash = nasty.withColumnRenamed("lang", "weight").withColumnRenamed("source", "rank").repartition(5)
    target = spark.createDataFrame([("one two three",), (None,), ("",), ("é à ü",)], "text string")
    got = rows_of(importance.importance_ranks(clash, target, percent=60, least_words=1))
    assert got == brute([(r["doc_id"], r["text"]) for r in nasty.collect()], ["one two three", None, "", "é à ü"], 60, 1)
    assert rows_of(importance.importance_ranks(empty, target)) == []
    alone = importance.importance_ranks(nasty, empty).collect()
    assert len(alone) == nasty.count() and importance.bucket_counts(empty) == [0] * 10_000


def test_ranks_of_repeated_rows_have_no_gap(spark):
    rows = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c d").alias("text")).union(spark.range(300).select("id", F.lit("a b x")))
    out = importance.importance_ranks(rows.repartition(9), rows.limit(1), percent=50, least_words=1)
    ranks = sorted(r["rank"] for r in out.collect() if r["rank"])
    assert ranks == list(range(1, 351))
    by_rank = [r["score"] for r in out.where("rank > 0").orderBy("rank").collect()]
    assert by_rank == sorted(by_rank, reverse=True)


def test_tuples_have_the_hash_of_their_bytes():
    rng = random.Random(4)
    vocab = ["a", "bb", "x" * 63, "x" * 64, "x" * 65, "y" * 3000, "é", "中文", "7", "Zz"]
    texts = [" ".join(rng.choices(vocab, k=n)) for n in (0, 1, 2, 3, 40, 200)] + ["", "--", "A-b_C"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    per_row, found = importance.runs(data, at, 4)
    for i, t in enumerate(texts):
        w = WORD.findall(t.translate(LOWER))
        assert per_row[i] == len(w)
        for k, (crc, of, row) in enumerate(found, 1):
            assert crc[of[row == i]].tolist() == [zlib.crc32(" ".join(w[j : j + k]).encode()) for j in range(len(w) - k + 1)]
    assert all(len(set(of.tolist())) == len(crc) for crc, of, _ in found)
