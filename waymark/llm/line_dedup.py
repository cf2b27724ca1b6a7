"""Operator 10: line deduplication by an exact set-similarity join.

A line's tokens are its distinct 5-word shingles (a shorter line is one token, a line without words none and never removed). A
line is removed if an earlier line, by (doc_id, line number), has a token set with Jaccard similarity of at least
``num / den`` = 0.8. Whether the earlier line is itself removed makes no difference.

Method. Equal token sets are one class, known by its first line; later lines of a class are removed at once. Between classes:
tokens are ordered by rarity (counts of all tokens in a fixed number of hashed counters, by powers of two, then the hash), each class gives its
prefix of n - ceil(0.8 n) + 1 rarest tokens, and classes that share a prefix token are compared if their lengths and the
token's positions still permit the similarity, and a parity sketch of 128 bits does. Survivors are verified on their tokens.

Scale. Prefix tokens cross the network packed and are matched by sorting arrays in partitions of a fixed number of tokens; a token
that many classes of one chunk have sends two of them to its partition and the rest to any. A class is done once any earlier
similar one is known. So the classes of a token first meet only its earliest class, then one drawn by a hash (stars, linear in the
rows); only what is still undecided meets the others, at last pair by pair. Copies of a very frequent line are pre-aggregated
before each shuffle.

Cases. A null text has no lines. Rows that repeat an id with the same text are one document and each is returned. Null ids sort
first. Line ends are ``\\n``; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import kernel as K
from waymark.llm.common import Scratch, free_name, small

#: Hashed counters of token frequency: the bound of what is sent to the tasks.
COUNTERS = 1 << 16
#: Prefix tokens of one partition, on average, and of one packed chunk.
TOKENS_A_PARTITION, CHUNK = 1_000_000, 250_000
#: Bytes of line numbers by document that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Classes of a token of which each is compared with each, in its partition, before any is sent on; of a larger group all are.
NEIGHBOURS = 32
MAX_STARS = 2
#: Comparisons for each undecided class of a token that are made in the join rather than by another star.
PAIRS_A_ROW = 64


def line_sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the column: first row, tokens and their lines, and (line, size, id) of each line with words, and the rows of all lines.

    A line is known by its running number in the slice; ``rows`` and ``numbers`` give its row and its number in the text.
    """
    for i, _, data, at in K.slices(col):
        w = K.Words(data, at)
        ends = np.cumsum(data == 10) if len(data) else np.zeros(0, np.int64)
        before = np.where(at[:-1] > 0, ends[np.maximum(at[:-1] - 1, 0)] if len(ends) else 0, 0)
        number = (ends[w.start] if len(w) else np.zeros(0, np.int64)) - before[w.row]
        line = (ends[w.start] if len(w) else np.zeros(0, np.int64)) + w.row
        tokens, of = K.distinct(*K.shingles(w.hash, line, k))
        lines, size, ids = K.digests(tokens, of)
        head = K.heads(line)
        yield i, tokens, of, lines, size, ids, np.stack([w.row[head], number[head]])


def line_counts(col: pa.Array) -> pa.Array:
    """How many lines each text has; a null none."""
    data, at = K.buffers(col)
    ends = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    n = np.searchsorted(ends, at[1:], side="right") - np.searchsorted(ends, at[:-1], side="right") + 1
    return pa.array(np.where(col.is_null().to_numpy(zero_copy_only=False), 0, n))


def counters(docs: DataFrame, k: int) -> np.ndarray:
    """How often the tokens of each hashed counter occur in all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, data, at in K.slices(batch.column(0)):
                w = K.Words(data, at)
                ends = np.cumsum(data == 10) if len(data) else np.zeros(0, np.int64)
                tokens, _ = K.shingles(w.hash, (ends[w.start] if len(w) else np.zeros(0, np.int64)) + w.row, k)
                total += np.bincount((tokens >> K.U(48)).astype(np.int64), minlength=COUNTERS)
        full = np.flatnonzero(total)
        for s in range(0, len(full), 10_000):
            own = full[s : s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["slot", "n"])

    found = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array of 32 bits, first all lowest ones; the others are mostly 0 and cost little once compressed."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def packed(token: np.ndarray, lid: np.ndarray, n: np.ndarray, pos: np.ndarray, partitions: int) -> Iterator[tuple[int, bool, bytes]]:
    """(partition, wide, data) of a chunk's prefix tokens.

    Of a token that several classes of the chunk have, two go to the token's partition, marked in the top bit of ``pos``; the rest is
    wide: known to be shared, and may go anywhere.
    """
    order = np.argsort(token, kind="stable")
    token, lid, n, pos = token[order], lid[order], n[order], pos[order].astype(np.uint32)
    wide, mark = np.zeros(len(token), bool), np.zeros(len(token), bool)
    wide[2:] = token[2:] == token[:-2]
    mark[:-2] = wide[2:]
    mark[1:-1] |= wide[2:]
    pos[mark & ~wide] |= np.uint32(1 << 31)
    own = (token >> K.U(40)) * K.U(partitions) >> K.U(24)
    own[wide] = K.mix(lid[wide].view(K.U)) % K.U(partitions)
    for kind in (False, True):
        pick = np.flatnonzero(wide == kind)
        pick = pick[np.argsort(own[pick], kind="stable")]
        to = own[pick]
        edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
        for a, e in zip(edge, np.append(edge[1:], len(to)), strict=False):
            rows = pick[a:e]
            yield int(to[a]), kind, token[rows].tobytes() + lid[rows].tobytes() + planes(n[rows]) + planes(pos[rows])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, lid, n, pos) of what :func:`packed` has made."""
    m = len(data) // 24
    thin = lambda at: np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * m, at).reshape(4, m).T).view(np.uint32).reshape(-1)
    return np.frombuffer(data, K.U, m), np.frombuffer(data, np.int64, m, 8 * m), thin(16 * m), thin(20 * m)


def line_table(docs: DataFrame, k: int, num: int, den: int, often: np.ndarray, partitions: int) -> DataFrame:
    """Three kinds of rows: ``(doc_id, th, line)`` of every row with the number of its lines, lines ``(doc_id, th, line, lid)``, and packed
    prefix tokens ``(part, wide, data)`` of each class, once in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            rows = list(packed(*map(np.concatenate, zip(*held, strict=True)), partitions))
            held.clear()
            bare = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([bare] * 4 + [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], NAMES)

        seen, waiting = np.zeros(0, np.int64), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), line_counts(batch.column(2)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary())], NAMES)
            for i, tokens, of, _, size, ids, where in line_sets(batch.column(2), k):
                if not len(ids):
                    continue
                rows, m = pa.array(i + where[0]), len(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(where[1]), pa.array(ids), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary())], NAMES)
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= (size > 3) & ~np.isin(ids, seen)  # up to three tokens, only equal sets are similar
                if not first.any():
                    continue
                seen = np.concatenate([seen, ids[first]])
                t, n, lid = tokens[np.repeat(first, size)], size[first], ids[first]
                line = np.repeat(np.arange(len(n)), n)
                # by rarity, then value: the counters are in front, in as many bits as their logarithm needs
                order = K.order_of(often[(t >> K.U(48)).astype(np.int64)] << K.U(58) | t >> K.U(6), line)
                pos = np.arange(len(t)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                short = pos < np.repeat(n - -(-num * n // den) + 1, n)
                of_class = line[order][short]
                held.append((t[order][short], lid[of_class], n[of_class], pos[short]))
                waiting += int(short.sum())
                if waiting >= CHUNK:
                    yield flush()
                    seen, waiting = np.zeros(0, np.int64), 0
        if held:
            yield flush()

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, line long, lid long, part int, wide boolean, data binary")


NAMES = ["doc_id", "th", "line", "lid", "part", "wide", "data"]


def shared_tokens(chunks: DataFrame, num: int, den: int) -> DataFrame:
    """``(token, lid, n, pos)`` of tokens that two classes of fitting sizes have, from the chunks of whole partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for wide, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                token, lid, n, pos = unpacked(data.as_buffer().to_pybytes())
                if wide:
                    yield from rows(token, lid, n, pos)
                else:
                    found.append((token, lid, n, pos))
        if not found:
            return
        token, lid, n, pos = map(np.concatenate, zip(*found, strict=True))
        found.clear()
        order = np.argsort(token)
        token = token[order]
        same = np.zeros(len(token), bool)  # tokens of one class go here, which spares most rows the sort below
        same[1:] = token[1:] == token[:-1]
        same[:-1] |= same[1:]
        order, token = order[same], token[same]
        lid, n, pos = lid[order], n[order].astype(np.int64), pos[order]
        order = np.lexsort((lid, n, token))
        token, lid, n, pos = token[order], lid[order], n[order], pos[order]
        if not len(token):
            return
        head = np.concatenate(([True], token[1:] != token[:-1]))
        more = np.repeat(np.bitwise_or.reduceat(pos >> np.uint32(31), np.flatnonzero(head)), np.diff(np.append(np.flatnonzero(head), len(token)))) > 0
        pos &= np.uint32((1 << 31) - 1)
        new = head.copy()
        new[1:] |= lid[1:] != lid[:-1]  # equal sets have equal sizes, so copies of a class are neighbours
        token, lid, n, pos, more = token[new], lid[new], n[new], pos[new].astype(np.int64), more[new]
        # within a token by size: whether any other class fits, by length and position; of a larger group all stay
        keep = more.copy()
        for step in range(1, NEIGHBOURS + 1):
            if step >= len(token):
                break
            same = token[step:] == token[:-step]
            if step == NEIGHBOURS:
                near = same
            else:
                a, b = n[:-step], n[step:]
                near = same & (a * den >= b * num) & (np.minimum(a - pos[:-step], b - pos[step:]) * (den + num) >= (a + b) * num)
            keep[step:] |= near
            keep[:-step] |= near
            if step == NEIGHBOURS and near.any():
                large = np.unique(token[step:][near])
                keep |= np.isin(token, large)
        yield from rows(token[keep], lid[keep], n[keep], pos[keep])

    def rows(token: np.ndarray, lid: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(lid), 100_000):
            e = s + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(token[s:e].view(np.int64)), pa.array(lid[s:e]), pa.array(n[s:e].astype(np.int64)), pa.array(pos[s:e].astype(np.int64))], ["token", "lid", "n", "pos"])

    return chunks.select("wide", "data").mapInArrow(run, "token long, lid long, n long, pos long")


def token_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(lid, doc_id, th, line, s0, s1, tokens)`` of the lines of ``docs(doc_id, th, text, wanted)`` whose numbers are wanted; ``s0`` and ``s1`` are a parity sketch of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            asked = row << 40 | wanted.flatten().to_numpy()
            for i, tokens, _, _, size, ids, where in line_sets(batch.column(2), k):
                keep = np.isin((i + where[0]) << 40 | where[1], asked)
                if keep.any():
                    own, n, rows = tokens[np.repeat(keep, size)], size[keep], pa.array(i + where[0][keep])
                    begin, bit = np.concatenate(([0], np.cumsum(n)[:-1])), (own >> K.U(40)) & K.U(127)
                    sketch = [np.bitwise_xor.reduceat(np.where(bit >> K.U(6) == q, K.U(1) << (bit & K.U(63)), K.U(0)), begin).view(np.int64) for q in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(where[1][keep]), *map(pa.array, sketch), K.ragged(own.view(np.int64), n, pa.int64())], names)

    names = ["lid", "doc_id", "th", "line", "s0", "s1", "tokens"]
    return docs.select("doc_id", "th", "text", "wanted").mapInArrow(run, "lid long, doc_id long, th long, line long, s0 long, s1 long, tokens array<long>")


def similar(pairs: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The later classes ``lid`` of pairs ``(lid, other)`` that are similar, a table."""
    pairs = scratch.store(pairs, "pairs")
    asked = small(scratch.store(pairs.select(F.explode(F.array("lid", "other")).alias("asked")).distinct(), "asked"))
    sets = sets.join(asked, F.col("lid") == F.col("asked"), "left_semi")
    a = sets.select(F.col("lid").alias("a"), F.col("tokens").alias("at"))
    b = sets.select(F.col("lid").alias("b"), F.col("tokens").alias("bt"))
    both = pairs.join(a, pairs["lid"] == F.col("a")).join(b, F.col("other") == F.col("b"))
    shared = F.size(F.array_intersect("at", "bt"))
    out = scratch.store(both.where(shared * (den + num) >= (F.size("at") + F.size("bt")) * num).select("lid").distinct(), "similar")
    scratch.drop(pairs)
    return out


def with_earlier(members: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The classes of ``members(token, lid, n, pos, first, s0, s1)`` that have an earlier similar class."""
    cols = ["n", "pos", "s0", "s1"]

    def fits(other: str) -> Column:
        """Length, position and Hamming distance of the sketches, which is at most the tokens that only one has, permit the similarity."""
        (n, pos, s0, s1), (m, at, t0, t1) = ([F.col(f"{x}{c}") for c in cols] for x in ("", other))
        length = F.least(n, m) * den >= F.greatest(n, m) * num
        far = F.bit_count(s0.bitwiseXOR(t0)) + F.bit_count(s1.bitwiseXOR(t1))
        return length & (F.least(n - pos, m - at) * (den + num) >= (n + m) * num) & (far * (den + num) <= (n + m) * (den - num))

    left = members.withColumn("open", F.lit(True))
    done = None
    for turn in range(MAX_STARS + 1):
        # the pivot is the earliest class, in later turns one drawn by a hash, so a class meets another one at each token
        draw = F.lit(0) if not turn else F.xxhash64("token", "lid", F.lit(turn))
        groups = left.groupBy("token").agg(F.count("*").alias("m"), F.count_if("open").alias("q"), F.min(F.struct(draw.alias("draw"), "first", "lid", *cols, "open")).alias("p"))
        groups = scratch.store(groups.where("m > 1 and q > 0"), "open")
        total = groups.agg(F.sum(F.col("q") * F.col("m")), F.sum("q")).first()
        if not total[1]:
            break
        last = turn == MAX_STARS or turn > 0 and total[0] <= PAIRS_A_ROW * total[1]
        if last:
            now = scratch.store(left.join(small(groups.select("token")), "token"), "rest")
            late = now.where("open").select("token", "lid", "first", *cols)
            early = now.select("token", F.col("lid").alias("other"), F.col("first").alias("o_first"), *(F.col(c).alias(f"o_{c}") for c in cols))
            pairs = late.join(early, "token").where((F.col("o_first") < F.col("first")) & fits("o_"))
        else:
            now = left.join(small(groups.select("token", "p")), "token")
            after = F.col("first") > F.col("p.first")
            star = now.where((F.col("lid") != F.col("p.lid")) & F.when(after, F.col("open")).otherwise(F.col("p.open")))
            pairs = star.where(fits("p.")).select(F.when(after, F.col("lid")).otherwise(F.col("p.lid")).alias("lid"), F.when(after, F.col("p.lid")).otherwise(F.col("lid")).alias("other"))
        found = similar(pairs.select("lid", "other").distinct(), sets, scratch, num, den)
        done = found if done is None else done.union(found)
        if last:
            break
        # each pivot has met all, so it leaves; classes that are done ask no more
        rest = now.where(F.col("lid") != F.col("p.lid")).drop("p")
        known = small(found.withColumnRenamed("lid", "known"))
        before, left = left, scratch.store(rest.join(known, rest["lid"] == F.col("known"), "left").withColumn("open", F.col("open") & F.col("known").isNull()).drop("known"), "left")
        scratch.drop(before)
    return (members.select("lid").where("false") if done is None else done).distinct()


def repeated_lines(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(doc_id, th, n_lines)`` of every row, and ``(doc_id, th, removed)``, the numbers of the removed lines, ascending, for documents that lose any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    often = counters(docs, k)
    rough = np.frompyfunc(int.bit_length, 1, 1)(often).astype(K.U)  # by powers of two, six bits
    # about one in five tokens, and one more of each line, is a prefix token
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(often.sum()) // (3 * TOKENS_A_PARTITION)))
    table = scratch.store(line_table(docs, k, num, den, rough, partitions), "lines")
    chunks = table.where("data is not null").repartitionById(partitions, "part")
    members = scratch.store(shared_tokens(chunks, num, den).distinct(), "members")
    place = F.struct("doc_id", "line", "th")
    rows = scratch.store(table.where("lid is null and data is null").select("doc_id", "th", F.col("line").cast("int").alias("n_lines")), "rows")
    lines = scratch.store(table.where("lid is not null").select("doc_id", "th", "line", "lid"), "lines")
    scratch.drop(table)
    # one aggregate tells each class's first line, how many lines it has, and whether it may be similar to another
    asked = members.select("lid", F.lit(None).cast(lines.select(place.alias("p")).schema["p"].dataType).alias("place"))
    classes = lines.select("lid", place.alias("place")).union(asked).groupBy("lid")
    classes = scratch.store(classes.agg(F.min("place").alias("first"), F.count("place").alias("lines"), F.count("*").alias("all")), "classes")
    firsts = classes.where("all > lines").select("lid", "first")
    chosen = firsts.groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("h")).agg(F.collect_set("first.line").alias("wanted"))
    chosen = few_numbers(scratch.store(chosen, "chosen"), "wanted")
    sets = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["th"] == F.col("h")))
    sets = scratch.store(token_sets(sets, k), "tokens")
    if not sets.groupBy("lid").count().where("count > 1").isEmpty():  # of documents whose row is repeated
        sets = scratch.store(sets.dropDuplicates(["lid"]), "tokens")
    known = small(sets.select("lid", place.alias("first"), "s0", "s1"))
    members = scratch.store(members.join(known, "lid"), "members")
    late = small(scratch.store(with_earlier(members, sets, scratch, num, den), "late")).withColumn("late", F.lit(True))
    marked = classes.join(late, "lid", "left").where("late or lines > 1").select("lid", "first", F.coalesce("late", F.lit(False)).alias("late"))
    marked = small(scratch.store(marked, "marked"))
    gone = lines.join(marked, "lid").where(F.col("late") | (place > F.col("first")))
    return rows, scratch.store(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")


def few_numbers(df: DataFrame, column: str) -> DataFrame:
    """Hint a broadcast of a stored table of line numbers by document if its bytes are few."""
    rows, numbers = df.agg(F.count("*"), F.sum(F.size(column))).first()
    return F.broadcast(df) if 48 * rows + 8 * (numbers or 0) <= BROADCAST_BYTES else df


def removed_lines(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` for every row of ``docs(doc_id, text)``."""
    with Scratch(docs.sparkSession) as scratch:
        rows, gone = map(scratch.keep, repeated_lines(docs, scratch, k, num, den))
    gone = few_numbers(gone, "removed").select(F.col("doc_id").alias("of"), F.col("th").alias("own"), "removed")
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("own")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def dedup_lines(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; all other columns stay."""
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.keep(repeated_lines(docs, scratch, k, num, den)[1])
    of, th, out = (free_name(docs, x) for x in ("line_of", "line_th", "line_removed"))
    gone = few_numbers(gone, "removed").toDF(of, th, out)
    text = docs["text"].cast("string")
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(th)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(out), i.cast("bigint"))), "\n")
    return joined.select(*(F.when(F.col(out).isNull(), text).otherwise(kept).alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns))
