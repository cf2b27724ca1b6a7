from __future__ import annotations

import numpy as np
import pyarrow as pa
from helpers import shingle_set, words
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import kernel as K

TEXT = st.text(alphabet=st.sampled_from("aAbé \t\n\x0b\x1fñ."), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 5), st.integers(1, 60))
def test_sets_are_the_same_as_pythons(texts, k, limit):
    before, K.SLICE_BYTES = K.SLICE_BYTES, limit
    try:
        sizes = np.zeros(len(texts), int)
        ids = {}
        for i, j, data, at in K.slices(pa.array(texts, pa.string())):
            w = K.Words(data, at)
            assert len(w) == sum(len(words(t)) for t in texts[i:j])
            rows, size, digest = K.digests(*K.distinct(*K.shingles(w.hash, w.row, k)))
            sizes[i + rows] = size
            ids |= dict(zip((i + rows).tolist(), digest.tolist(), strict=True))
    finally:
        K.SLICE_BYTES = before
    sets = [frozenset(shingle_set(words(t), k)) for t in texts]
    assert sizes.tolist() == [len(s) for s in sets]
    for a in ids:
        for b in ids:
            assert (ids[a] == ids[b]) == (sets[a] == sets[b])


def test_a_word_ends_at_its_row():
    (part,) = K.slices(pa.array(["ab", "cd", "", "ab"]))
    w = K.Words(*part[2:])
    assert w.row.tolist() == [0, 1, 3] and w.hash[0] == w.hash[2] != w.hash[1]


def test_sliced_columns_keep_their_rows():
    (part,) = K.slices(pa.array(["x y", "a b", "c"]).slice(1))
    assert K.Words(*part[2:]).row.tolist() == [0, 0, 1]
