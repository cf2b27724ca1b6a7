"""Operator 3: n-gram Jaccard join by parity sketches.

A text's set is its distinct ``k``-word shingles (a shorter text gives its whole word sequence as one, a text without
words none). Two texts link when ``den * |A and B| >= num * |A or B|``.

Method. Equal sets are collapsed to one id first. A set's tokens are XOR-hashed into a parity sketch that is cut into parts. A
token that only one of two sets has changes one part, so sketches differ in at most as many parts as the sets' symmetric
difference has tokens. In a size band with largest size ``hi`` two linked sets differ in at most ``d =
(den-num)*2*hi/(den+num)`` tokens; the band has ``P > d`` parts, so by the pigeonhole principle linked sets agree in at least
``P - d`` of them, and parts are equi-joined. As that many must agree, a set needs to be looked up only by its ``d + 1`` rarest
parts: in a common order of all parts, the first on which two sets agree is among them. Parts that no other set has come first
in that order, so a set whose parts are nearly all its own meets no other, however common the rest are. What meets is compared
by parity sketches of the whole sets, a short and then a long one, whose Hamming distance is a lower bound of the symmetric
difference, and then verified on the shingles.

Scale. Part keys cross the network packed, some eight bytes each, and are matched by sorting arrays in partitions of a fixed
number of keys. A key that many sets of one task share sends two of them to its partition and the rest to any. Each set first
meets the least set that has the same least key, in a few orders of the keys (stars, a few rows for each set), and components
are drawn. Only sets of one key that are still in different components are compared further: by a star for each key while that
is the cheaper way, at last pair by pair inside the join, which emits what the sketches leave. No link between components is
lost. A pair inside one component is skipped, as it cannot change a component.

Cases. Null or empty texts: ``n_shingles`` 0, linked with nothing. A row with a null doc_id takes no part in links and has a null
component. Repeated rows are one set, and each row is returned. Tokens and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import kernel as K
from waymark.llm.common import Scratch, small
from waymark.llm.components import components

#: Growth of the size bands; with it the parts of a set in its own and the next bands are fewest.
BAND_STEP = 1.6
#: Parts of a band beyond the ``d + 1`` of the pigeonhole principle, as a share of ``d``: so many more must agree.
SPARE = 0.25
#: Largest size for which bands are laid down; bands of a key take six bits.
LARGEST = 1 << 36
#: Keys of one partition, on average, and of one packed chunk.
KEYS_A_PARTITION, KEYS_A_CHUNK = 2_000_000, 1_000_000
#: Pairs of different components that keys may hold for each of their rows before these are drawn together by a star.
PAIRS_A_ROW = 16
#: Words of all long sketches of some pairs up to which they are broadcast (32 MB); beyond it the pairs are shuffled to them.
SKETCH_WORDS = 4_000_000
#: Orders of the keys by which sets first meet, and stars by which groups of near copies are drawn together before what is left is compared pair by pair.
STARS, MAX_STARS = 4, 2
#: Words of the sketch that is compared where sets meet pair by pair; it tells sets of some 2,000 tokens apart, the short one those of 500.
WIDE_WORDS = 16


def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowest size, greatest symmetric difference, parts) of each band; where no two different sets can link, no parts."""
    low = [1]
    while low[-1] <= LARGEST:
        low.append(max(low[-1] + 1, int(low[-1] * BAND_STEP)))
    high = np.array(low[1:]) - 1
    d = (den - num) * 2 * high // (den + num)
    return np.array(low), d, np.where(d > 0, d + 1 + np.maximum(1, np.ceil(d * SPARE).astype(np.int64)), 0)


def sets_of(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the column: first and end row, tokens and their rows, and (row, size, id) of each non-empty set."""
    for i, j, data, at in K.slices(col):
        w = K.Words(data, at)
        tokens, rows = K.distinct(*K.shingles(w.hash, w.row, k))
        yield i, j, tokens, rows, *K.digests(tokens, rows)


def reach(size: np.ndarray, low: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The own band of each size, and the band of the largest set that one of this size can link with."""
    return np.searchsorted(low, size, side="right") - 1, np.searchsorted(low, size * den // num, side="right") - 1


def emit(tokens: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part keys of some sets (``tokens`` in runs of ``size``): the runs' (set, slack), and keys and the run of each, ascending.

    A run is a set in a band. Its slack is the number of its parts, most common first, that it needs not be looked up by. Parts
    without tokens say nothing; they come last and are sent only where the others are too few. The low six bits of a key are its band.
    """
    low, d, parts = bands(num, den)
    own, last = reach(size, low, num, den)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    sets, slacks, keys, runs, done = [], [], [], [], 0
    with np.errstate(over="ignore"):
        for step in range(int((last - own).max(initial=0)) + 1):
            band = np.minimum(own + step, last)
            own_d = (den - num) * (size + np.minimum(low[band + 1] - 1, size * den // num)) // (den + num)
            pick = np.flatnonzero((own + step <= last) & (parts[band] > 0) & (own_d > 0))
            if not len(pick):
                continue
            n, p = size[pick], parts[band[pick]]
            base = np.concatenate(([0], np.cumsum(p)))
            inner = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            h = tokens[np.repeat(begin[pick], n) + inner]
            code = np.repeat(base[:-1], n) + (((K.mix(h ^ K.U(0x2545F4914F6CDD1D)) >> K.U(32)) * np.repeat(p, n).astype(K.U)) >> K.U(32)).astype(np.int64)
            word = np.zeros(base[-1], K.U)
            np.bitwise_xor.at(word, code, h)
            out = np.bincount(code, minlength=base[-1]) > 0
            of = np.repeat(np.arange(len(pick)), p)
            slack = np.add.reduceat(out, base[:-1], dtype=np.int64) - own_d[pick] - 1
            for x in np.flatnonzero(slack < 0):
                bare = base[x] + np.flatnonzero(~out[base[x] : base[x + 1]])
                out[bare[: -slack[x]]] = True
            part = np.arange(base[-1]) - np.repeat(base[:-1], p)
            salt = K.mix(part.astype(K.U) * K.U(1_000_003) + np.repeat(band[pick], p).astype(K.U))
            keys.append(K.mix(word ^ salt)[out] & ~K.U(63) | band[pick[of[out]]].astype(K.U))
            runs.append(done + of[out])
            sets.append(pick)
            slacks.append(np.maximum(slack, 0))
            done += len(pick)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, (sets, slacks, keys, runs)))


def mark_of(text: Column) -> Column:
    """By which a row is known beside its id, where ids are repeated."""
    return F.xxhash64(text.cast("string"))


def set_table(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(doc_id, n, sid, mark, parts)`` of every row of ``docs``: ``sid`` null for an empty set; about as many part keys as ``parts`` says."""
    names = ["doc_id", "n", "sid", "mark", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, _, count = bands(num, den)
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, _, _, _, at, size, ids in sets_of(batch.column(1), k):
                n[i + at], sid[i + at] = size, ids
            own, last = reach(np.maximum(n, 1), low, num, den)
            parts = count[own] + np.where(last > own, count[last], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sid, mask=n == 0), batch.column(2), pa.array(parts)], names)

    return docs.select("doc_id", "text", mark_of(F.col("text")).alias("mark")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def packed(sid: np.ndarray, slack: np.ndarray, keys: np.ndarray, runs: np.ndarray, to: np.ndarray, wide: bool) -> Iterator[tuple[int, bytes]]:
    """(partition, data) of keys: the ids and slacks of runs, how many keys each has, and the keys, eight bytes if ``wide``, else the low six."""
    order = np.argsort(to, kind="stable")
    keys, runs, to = keys[order], runs[order], to[order]
    heads = np.flatnonzero(np.concatenate(([True], (runs[1:] != runs[:-1]) | (to[1:] != to[:-1]))))
    count, of = np.diff(np.append(heads, len(keys))).astype(np.uint32), runs[heads]
    ids, spare = sid[of], np.minimum(slack[of], 65_535).astype(np.uint16)
    raw = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 6]
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    ends = np.append(first[1:], len(keys))
    for a, b, x, y in zip(first, ends, np.searchsorted(heads, first), np.searchsorted(heads, ends), strict=True):
        yield int(to[a]), np.uint32(y - x).tobytes() + ids[x:y].tobytes() + spare[x:y].tobytes() + count[x:y].tobytes() + raw[a:b].tobytes()


def unpacked(own: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, slacks, keys) of what :func:`packed` has made; ``own`` is the partition that narrow keys lie in, -1 for wide ones."""
    m = int(np.frombuffer(data, np.uint32, 1)[0])
    ids, slack, count = np.frombuffer(data, np.int64, m, 4), np.frombuffer(data, np.uint16, m, 4 + 8 * m), np.frombuffer(data, np.uint32, m, 4 + 10 * m)
    rest = np.frombuffer(data, np.uint8, offset=4 + 14 * m)
    if own < 0:
        keys = rest.view(K.U) if not rest.ctypes.data % 8 else np.frombuffer(rest.tobytes(), K.U)
    else:
        wide = np.zeros((len(rest) // 6, 8), np.uint8)
        wide[:, :6] = rest.reshape(-1, 6)
        keys = wide.reshape(-1).view(K.U) | (K.U(own & 0xFFFF) << K.U(48))
    return np.repeat(ids, count), np.repeat(slack, count), keys


def key_chunks(docs: DataFrame, k: int, num: int, den: int, partitions: int) -> DataFrame:
    """``(part, own, data)``: the packed part keys of the sets of ``docs``, for the partition ``part``.

    Of a key that several sets of a chunk have, two go to the key's partition, which tells it that the key is shared; the rest is
    wide, known to be shared, and may go anywhere.
    """
    names = ["part", "own", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            sid = np.concatenate([x[0] for x in held])
            slack = np.concatenate([x[1] for x in held])
            shift = np.concatenate(([0], np.cumsum([len(x[0]) for x in held])[:-1]))
            keys = np.concatenate([x[2] for x in held])
            runs = np.concatenate([x[3] + s for x, s in zip(held, shift, strict=True)])
            held = []
            part = (keys >> K.U(40)) * K.U(partitions) >> K.U(24)
            keys = keys & K.U(0xFFFF_FFFF_FFFF) | part << K.U(48)  # what a narrow key becomes again
            order = np.argsort(keys, kind="stable")
            sorted_ = keys[order]
            more = np.zeros(len(keys), bool)
            more[order[2:]] = sorted_[2:] == sorted_[:-2]  # a set is in a chunk once, so a key's rows are of different sets
            for wide, pick in ((False, ~more), (True, more)):
                if pick.any():
                    own = keys[pick]
                    to = part[pick].astype(np.int64) if not wide else (K.mix(sid[runs[pick]].view(K.U)) % K.U(partitions)).astype(np.int64)
                    rows = list(packed(sid, slack, own, runs[pick], to, wide))
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([-1 if wide else p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names)

        seen, waiting = np.zeros(0, np.int64), 0
        for batch in batches:
            for _, _, tokens, _, _, size, ids in sets_of(batch.column(0), k):
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= ~np.isin(ids, seen)
                if not first.any():
                    continue
                sets, slack, keys, runs = emit(tokens[np.repeat(first, size)], size[first], num, den)
                seen = np.concatenate([seen, ids[first]])
                if len(keys):
                    held.append((ids[first][sets], slack, keys, runs))
                    waiting += len(keys)
                if waiting >= KEYS_A_CHUNK:
                    yield from flush()
                    seen, waiting = np.zeros(0, np.int64), 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "part int, own int, data binary")


def shared_keys(chunks: DataFrame) -> DataFrame:
    """``(sid, key, slack)`` of keys that two sets have, from the chunks of whole partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, slack, keys = unpacked(own, data.as_buffer().to_pybytes())
                if own < 0:
                    yield from rows(ids, keys, slack)
                else:
                    found.append((ids, slack, keys))
        if not found:
            return
        ids, slack, keys = map(np.concatenate, zip(*found, strict=True))
        found.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(head, len(keys)))
        ids = ids[order]
        keep = np.repeat((size > 1) & (np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)), size)
        yield from rows(ids[keep], keys[keep], slack[order][keep])

    def rows(ids: np.ndarray, keys: np.ndarray, slack: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(ids), 100_000):
            e = s + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), pa.array(keys[s:e].view(np.int64)), pa.array(slack[s:e].astype(np.int64))], ["sid", "key", "slack"])

    return chunks.select("own", "data").mapInArrow(run, "sid long, key long, slack long")


def near_sets(docs: DataFrame, scratch: Scratch, k: int, num: int, den: int, partitions: int) -> DataFrame:
    """``(sid, keys)``: sets that may link, with the keys by which they are looked up."""
    chunks = key_chunks(docs, k, num, den, partitions).repartitionById(partitions, "part")
    shared = scratch.store(shared_keys(chunks), "shared")
    run = ["sid", F.col("key").bitwiseAND(63).alias("band")]
    met = shared.groupBy(*run).agg(F.max("slack").alias("slack"), F.collect_set("key").alias("keys")).where(F.size("keys") > F.col("slack"))
    met = scratch.store(met, "met")
    scratch.drop(shared)
    rows = met.select("sid", "slack", F.explode("keys").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    ranked = rows.join(often, "key").groupBy(*run).agg(F.max("slack").alias("slack"), F.array_sort(F.collect_list(F.struct("often", "key"))).alias("keys"))
    kept = ranked.where(F.size("keys") > F.col("slack")).select("sid", F.explode(F.slice("keys.key", F.lit(1), (F.size("keys") - F.col("slack")).cast("int"))).alias("key"))
    near = scratch.store(kept.groupBy("sid").agg(F.collect_list("key").alias("keys")), "near")
    scratch.drop(met)
    return near


def token_table(docs: DataFrame, k: int) -> DataFrame:
    """``(sid, n, s0..s3, bits, wide, tokens)`` of rows ``(sid, text)``: the short and the long sketch, one of WIDE_WORDS words, and the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, tokens, rows, at, size, ids in sets_of(batch.column(1), k):
                keep = ids == want[i + at]
                if not keep.any():
                    continue
                inside = np.repeat(keep, size)
                tokens, size, ids = tokens[inside], size[keep], ids[keep]
                begin = np.concatenate(([0], np.cumsum(size)[:-1]))
                bit = (tokens >> K.U(40)) & K.U(255)
                sketch = [np.bitwise_xor.reduceat(np.where(bit >> K.U(6) == q, K.U(1) << (bit & K.U(63)), K.U(0)), begin).view(np.int64) for q in range(4)]
                bits, width = long_sketches(tokens, size)
                wide, same = long_sketches(tokens, size, WIDE_WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), *map(pa.array, sketch), K.ragged(bits, width, pa.int64()), K.ragged(wide, same, pa.int64()), K.ragged(tokens.view(np.int64), size, pa.int64())], ["sid", "n", "s0", "s1", "s2", "s3", "bits", "wide", "tokens"])

    return docs.select("sid", "text").mapInArrow(run, "sid long, n long, s0 long, s1 long, s2 long, s3 long, bits array<long>, wide array<long>, tokens array<long>")


def long_sketches(tokens: np.ndarray, size: np.ndarray, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of ``words`` words, else with a power of two of words that grows with the set, about eight bits for each token that may differ."""
    width = np.full(len(size), words, np.int64) if words else 1 << np.ceil(np.log2(np.maximum(size * 1.3 / 64, 1))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(width)))
    h = K.mix(tokens ^ K.U(0x94D049BB133111EB))
    word = np.zeros(base[-1], K.U)
    at = np.repeat(base[:-1], size) + ((h >> K.U(6)) & np.repeat(width - 1, size).astype(K.U)).astype(np.int64)
    np.bitwise_xor.at(word, at, K.U(1) << (h & K.U(63)))
    return word.view(np.int64), width


SKETCH = ["n", "s0", "s1", "s2", "s3"]
WIDE = [f"w{q}" for q in range(WIDE_WORDS)]


def may_link(a: str, b: str, num: int, den: int, words: list[str] = SKETCH[1:]) -> Column:
    """The length filter, and the Hamming filter: the sketches differ in at most as many bits as linked sets may differ in tokens."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    far = F.lit(0)
    for q in words:
        far = far + F.bit_count(F.col(f"{a}{q}").bitwiseXOR(F.col(f"{b}{q}")))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (far * (den + num) <= (n + m) * (den - num))


def folded(a: str, b: str) -> Column:
    """The long sketch ``a`` at the width of ``b``: of two halves the parity, where it is the wider one."""
    half = (F.size(a) / 2).cast("int")
    return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(a))


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """A table of the pairs ``(a, b)`` that link.

    The long sketches, a fiftieth of the tokens, reject nearly all that do not; only what they leave is joined to its tokens.
    """
    sides = lambda cols, only: (only.select(F.col("sid").alias(f"{x}_sid"), *(F.col(c).alias(f"{x}_{c}") for c in cols)) for x in "ab")

    def of_pairs(rows: DataFrame) -> DataFrame:
        asked = small(scratch.store(rows.select(F.explode(F.array("a", "b")).alias("asked")).distinct(), "asked"))
        return sets.join(asked, F.col("sid") == F.col("asked"), "left_semi")

    pairs = scratch.store(pairs, "pairs")
    bits = scratch.store(of_pairs(pairs).select("sid", "n", "bits"), "bits")
    words = bits.agg(F.sum(F.size("bits"))).first()[0] or 0
    a, b = sides(["n", "bits"], bits)
    if words <= SKETCH_WORDS:
        a, b = F.broadcast(a), F.broadcast(b)
    both = pairs.join(a, F.col("a") == F.col("a_sid")).join(b, F.col("b") == F.col("b_sid"))
    far = F.aggregate(F.zip_with(folded("a_bits", "b_bits"), folded("b_bits", "a_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = scratch.store(both.where(far * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num)).select("a", "b"), "close")
    scratch.drop(bits, pairs)
    a, b = sides(["tokens"], of_pairs(close))
    both = close.join(a, F.col("a") == F.col("a_sid")).join(b, F.col("b") == F.col("b_sid"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    links = scratch.store(both.where(shared * (den + num) >= (F.size("a_tokens") + F.size("b_tokens")) * num).select("a", "b"), "links")
    scratch.drop(close)
    return links


def pair() -> list[Column]:
    """The pair of a row's set with another one, lesser id first."""
    return [F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")]


def first_stars(near: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of each set with the least set that has the same least part key, in several orders of the keys.

    Near copies agree in most keys, so most of a group meet in few such stars, at a few rows for each set.
    """
    stars = F.array(*(F.array_min(F.transform("keys", lambda k, q=q: F.xxhash64(k, F.lit(q)))) for q in range(STARS)))
    rows = near.select("sid", *SKETCH, F.posexplode(stars).alias("q", "least_key"))
    pivots = rows.groupBy("q", "least_key").agg(F.min(F.struct("sid", *SKETCH)).alias("p"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = rows.join(pivots, ["q", "least_key"]).withColumn("other", F.col("p.sid"))
    return met.where((F.col("sid") != F.col("other")) & may_link("", "p.", num, den)).select(*pair()).distinct()


def rest_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of all sets ``rows(key, sid, label, n, s0..s3, w0..)`` of one key and different components.

    The condition is the join's own. Near copies that just do not link share many keys, and the short sketch lets nearly all of their pairs through.
    """
    other = rows.select("key", F.col("sid").alias("other"), F.col("label").alias("other_label"), *(F.col(c).alias(f"o_{c}") for c in SKETCH + WIDE))
    close = may_link("", "o_", num, den) & may_link("", "o_", num, den, WIDE)
    return rows.join(other, "key").where((F.col("label") < F.col("other_label")) & close).select(*pair())


def linked(near: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """``(sid, label)``: components of the sets ``near(sid, keys)`` that link."""
    near = scratch.store(near.join(sets.select("sid", *SKETCH), "sid"), "near")
    edges = verified(first_stars(near, num, den), sets, scratch, num, den)
    labels = components(edges, scratch)
    gone = None
    for turn in range(MAX_STARS + 1):
        # what is left: sets of keys whose sets lie in several components
        known = near.join(small(labels.withColumnRenamed("sid", "of")), F.col("sid") == F.col("of"), "left").withColumn("label", F.coalesce("label", "sid"))
        left = known.select(F.explode("keys").alias("key"), "sid", "label", *SKETCH)
        if gone is not None:  # pivots that have met all sets of their key
            left = left.join(gone, ["key", "sid"], "left_anti")
        # a key's pivot is drawn by a hash of both, so a set meets another pivot at each of its keys
        groups = left.groupBy("key", "label").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("sid", "key").alias("h"), "sid", "label", *SKETCH)).alias("least"))
        sums = groups.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count("*").alias("labels"), F.min("least").alias("p"))
        open_ = scratch.store(sums.where("labels > 1").select("key", "m", ((F.col("m") * F.col("m") - F.col("sq")) / 2).alias("pairs"), "p"), "open")
        total = open_.agg(F.sum("pairs"), F.sum("m")).first()
        if not total[1]:
            break
        last = turn == MAX_STARS or turn > 0 and total[0] <= PAIRS_A_ROW * total[1]
        if last:
            now = scratch.store(left.join(small(open_.select("key")), "key"), "rest")
            wide = sets.select("sid", *(F.col("wide")[q].alias(w) for q, w in enumerate(WIDE))).join(now.select("sid").distinct(), "sid")
            pairs = rest_pairs(now.join(small(scratch.store(wide, "wide")), "sid"), num, den)
        else:
            now = left.join(small(open_.select("key", "p")), "key")
            pairs = now.where((F.col("label") != F.col("p.label")) & may_link("", "p.", num, den)).withColumn("other", F.col("p.sid")).select(*pair())
        found = verified(pairs.distinct(), sets, scratch, num, den)
        if not found.isEmpty():
            edges = edges.union(found)
            labels = components(edges, scratch)
        if last:
            break
        met = open_.select("key", F.col("p.sid").alias("sid"))
        gone = met if gone is None else gone.union(met)
    return labels


def ngram_jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``; see the module's text."""
    return row_components(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The same with ``mark``, the text's, and ``label``, which tells components apart whose least ids are equal (null for an empty set).

    The frame reads two narrow tables of the scratch folder, those of all rows and of the classes; all others are deleted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    known = F.col("sid").isNotNull() & F.col("doc_id").isNotNull()
    with Scratch(spark) as scratch:
        table = scratch.store(set_table(docs, k, num, den), "rows")
        keys = table.where(known).agg(F.sum("parts")).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // KEYS_A_PARTITION))
        near = near_sets(docs.where("doc_id is not null"), scratch, k, num, den, min(partitions, 1 << 22))
        first = scratch.store(table.where(known).groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
        chosen = small(scratch.store(first.join(near.select("sid"), "sid").select(F.col("rep").alias("doc_id"), "sid"), "chosen"))
        sets = scratch.store(token_table(docs.join(chosen, "doc_id").select("sid", "text"), k).dropDuplicates(["sid"]), "tokens")
        named = linked(near, sets, scratch, num, den).join(first, "sid")
        least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        linked_to = named.join(least, "label").select("sid", "component_id", "label")
        # a set that one row has and that links with no other needs no entry
        classes = first.join(linked_to, "sid", "left").where("copies > 1 or component_id is not null")
        classes = small(scratch.keep(scratch.store(classes.select("sid", F.coalesce("component_id", "rep").alias("component_id"), "label"), "components")))
        scratch.keep(table)
    alone = table.where(~known).select("doc_id", "n", F.when(F.col("sid").isNull(), F.col("doc_id")).alias("component_id"), "mark", F.col("sid").alias("label"))
    rest = table.where(known).join(classes, "sid", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"), "mark", F.coalesce("label", "sid").alias("label"))
    return rest.union(alone).withColumnRenamed("n", "n_shingles")
