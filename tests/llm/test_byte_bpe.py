from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import LONG
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import byte_bpe
from waymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return byte_bpe.Codec(f.read(), PATTERN)


def whole(codec, text):
    return codec.by_pattern.encode(text, disallowed_special=())


def test_query_matches_the_library_on_every_document(spark, docs, codec):
    want = {}
    for r in docs.collect():
        ids = whole(codec, r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op12_byte_bpe"](spark, SF).collect()}
    assert got == want and len(got) == docs.count()


WORDS = ["a", "don't", "'s", " 'll", "x" * 40, "中文字", "，", "。", "12", "٣٤", "é", "é", "!!", "...", "-", "\n", "\n\n", "\t", "  ", " ", " ", "　", "\u0085", "\x1c", "​", "😀", "(", ")", "<|endoftext|>", "ß", "ё"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=5)), max_size=60), st.integers(1, 40))
def test_spans_do_not_change_the_ids(codec, parts, span):
    text = "".join(parts)
    pieces = list(byte_bpe.spans(text, span))
    assert "".join(p for p, _ in pieces) == text
    assert [i for p, one in pieces for i in (codec.as_one if one else codec.by_pattern).encode(p, disallowed_special=())] == whole(codec, text)


def test_long_texts(codec):
    rng = random.Random(3)
    prose = "".join(rng.choice(WORDS) for _ in range(60_000))
    for text in (LONG, prose, "ab" * 60_000, "中" * 50_000, " " * 30_000 + "x", "x" + "\n" * 30_000, "y" + " " * 20_000 + "\t" + "12"):
        parts = list(byte_bpe.spans(text))
        assert codec.encode(text).tolist() == whole(codec, text) and codec.decode(codec.encode(text).tolist()) == text.encode()
        assert len(text.split()) < 1000 or max(len(p) for p, _ in parts) < 2 * byte_bpe.SPAN
    blank = " " * 1_500_000  # the pattern alone runs out of stack here
    assert codec.decode(codec.encode("a" + blank + "b").tolist()) == ("a" + blank + "b").encode()


def test_cases(spark, nasty, empty, codec):
    df = nasty.withColumnRenamed("source", "IDS").withColumnRenamed("lang", "bytes")
    out = byte_bpe.encoded(df, RANKS, PATTERN)
    assert out.columns == [*df.columns, "ids_"] and out.count() == nasty.count()
    back = byte_bpe.decoded(out, RANKS, PATTERN, "ids_")
    assert back.columns[-1] == "bytes_"
    for r in back.collect():
        assert r["ids_"] == whole(codec, r["text"] or "") and bytes(r["bytes_"]) == (r["text"] or "").encode()
    assert byte_bpe.decoded(byte_bpe.encoded(empty, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_decoding_gives_raw_bytes(spark, codec):
    ids = whole(codec, "😀")
    assert len(ids) > 1
    rows = spark.createDataFrame([(1, ids[:1]), (2, [None, *ids, None]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decoded(rows, RANKS, PATTERN).collect()}
    assert got[1] == codec.decode(ids[:1]) and "😀".encode().startswith(got[1]) and got[2] == "😀".encode() and got[3] == got[4] == b""
    with pytest.raises(Exception, match="(?s)Invalid token|KeyError"):
        byte_bpe.decoded(rows.withColumn("ids", F.array(F.lit(60_000))), RANKS, PATTERN).collect()
