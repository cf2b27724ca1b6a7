"""Vectorised text kernels: they work on the byte buffer of a whole Arrow column slice, without a loop over rows.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Words get a 64-bit polynomial hash over a table of
random byte codes, shingles a 64-bit mix of their words' hashes. Two texts share a hash by chance with a probability of
2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 250_000

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def codes(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_CODE = codes(256, 1)[LOWER]
STEP = codes(64, 2) | U(1)
BASE = 0x9E3779B97F4A7C17
_powers, _inverse = np.ones(1, U), np.ones(1, U)
#: Bytes of a slice up to which words are hashed by running sums; a longer one, of a single text, takes powers of its longest word only.
RUNNING = 1 << 22


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd number, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = geometric(BASE, 2 * n)
    return _powers


def inverses(n: int) -> np.ndarray:
    """The inverses of at least ``n`` powers."""
    global _inverse
    if len(_inverse) < n:
        _inverse = geometric(pow(BASE, -1, 1 << 64), 2 * n)
    return _inverse


def geometric(base: int, n: int) -> np.ndarray:
    step = np.full(n, base, U)
    step[0] = 1
    return np.cumprod(step, dtype=U)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    at = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about SLICE_BYTES."""
    data, at = buffers(col)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of some rows: ``hash``, ``row`` and byte range (``start``, ``end``) of each, in order."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        inside = ~IS_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = at[(at > 0) & (at < len(data))]
        first[cuts] |= inside[cuts]
        self.start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(at, self.start, side="right") - 1
        length = self.end - self.start
        if len(self.start):
            with np.errstate(over="ignore"):
                if len(data) <= RUNNING:
                    upto = np.zeros(len(data) + 1, U)
                    np.cumsum(BYTE_CODE[data] * powers(len(data))[: len(data)], out=upto[1:])
                    total = (upto[self.end] - upto[self.start]) * inverses(len(data))[self.start]
                else:
                    where = np.flatnonzero(inside)
                    inner = where - np.repeat(self.start, length)
                    part = BYTE_CODE[data[where]] * powers(int(length.max()))[inner]
                    total = np.add.reduceat(part, np.concatenate(([0], np.cumsum(length)[:-1])))
                self.hash = mix(total + length.astype(U) * U(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.hash)


def shingles(words: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each group (ids ascending) and their groups; a shorter group gives itself as one."""
    n = len(words)
    out, of = [], []
    with np.errstate(over="ignore"):
        if n >= k:
            whole = group[: n - k + 1] == group[k - 1 :]
            total = np.zeros(n - k + 1, U)
            for j in range(k):
                total += words[j : n - k + 1 + j] * STEP[j]
            out.append(mix(total[whole]))
            of.append(group[: n - k + 1][whole])
        if n:
            head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.append(head, n))
            for m in range(1, k):
                at = head[size == m]
                if len(at):
                    total = np.full(len(at), 0xA0761D6478BD642F * m % 2**64, U)
                    for j in range(m):
                        total += words[at + j] * STEP[j]
                    out.append(mix(total))
                    of.append(group[at])
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def order_of(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order by group and value, hashes or small numbers: one sort of both in 64 bits; where the bits left for a hash do not tell two apart, a sort by two keys."""
    if not len(values):
        return np.zeros(0, np.int64)
    bits = int(group.max()).bit_length()
    if values.dtype != U:  # small numbers: both fit as they are
        return np.argsort(group.astype(np.int64) * (int(values.max()) + 1) + values, kind="stable")
    if bits > 32:
        return np.lexsort((values, group))
    joint = group.astype(U) << U(64 - bits) | values >> U(bits) if bits else values
    order = np.argsort(joint)
    joint, values = joint[order], values[order]
    same = joint[1:] == joint[:-1]
    if (values[1:][same] == values[:-1][same]).all():
        return order
    return order[np.lexsort((values, joint))]


def distinct(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each group, sorted by group and value."""
    order = order_of(values, group)
    values, group = values[order], group[order]
    if len(values):
        keep = np.concatenate(([True], (values[1:] != values[:-1]) | (group[1:] != group[:-1])))
        values, group = values[keep], group[keep]
    return values, group


def heads(group: np.ndarray) -> np.ndarray:
    """Where each group of a sorted array begins."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)


def digests(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, size, 64-bit digest) of each non-empty set; ``values`` as from :func:`distinct`."""
    at = heads(group)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(group)))
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), at)
        return group[at], size, mix(total + size.astype(U) * U(0xDA942042E4DD58B5)).view(np.int64)


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, kind))
