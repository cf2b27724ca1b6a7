"""Operator 5: sharding by sampled splitters. DataFrame functions only.

Law ``bytes``: shards get nearly equal bytes. Records are ordered by a 64-bit hash of their text, so equal texts lie together.
Keys are drawn with a chance in proportion to the record's size, quantiles of the draw are the splitters, and records are
range-partitioned by them into many more ranges than shards. A key that fills a quantile alone gets a range of its own, and an
overfull range is subdivided (by key; a single key's range by id), so no range grows with one hot text. The exact bytes of all
ranges, a bounded table, then decide the shards: ranges of one hot text go to the emptiest shards (whole, if they fit one),
the others fill up the shards in key order. A slot is the range's offset in its shard plus the row's place in its range, so
no window is larger than a range.

Bounds. The driver holds ``cells`` splitters and the counts of the ranges (at most about three times as many). ``cells`` grows
with the bytes up to MAX_CELLS.

Cases. A null text has size 1, no text_crc32 and one key with all null texts. Null ids and repeated rows get slots as all rows do; which
of two equal rows has which slot is open. An empty table gives an empty one. Fewer records than shards leave shards empty.
"""

from __future__ import annotations

import bisect
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, free_name

MIN_CELLS, MAX_CELLS = 1 << 12, 1 << 13
#: Bytes of a range at which more ranges are made.
CELL_BYTES = 1 << 26


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def key_of(text: Column) -> Column:
    """A hash of the text; that of a null is the hash's seed, one key for all nulls."""
    return F.xxhash64(text)


def position(table: Column, key: Column) -> Column:
    """How many of the ascending splitters in an array column are at most ``key``, by binary search."""
    steps = F.array(*(F.lit(1 << i) for i in range(MAX_CELLS.bit_length() + 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(lo + s <= F.size(table), F.when(F.get(table, lo + s - 1) <= key, lo + s).otherwise(lo)).otherwise(lo))


def splitters_of(rows: DataFrame, total: int, cells: int) -> list[int]:
    """Ascending splitters from a size-weighted draw of about eight keys for each range."""
    want = 8 * cells
    # a record is drawn in proportion to its size; large ones several times
    expected = F.col("size") * F.lit(want / max(total, 1))
    u = F.pmod(F.xxhash64("key", "doc_id", F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    times = F.floor(expected) + (u < expected - F.floor(expected)).cast("long")
    drawn = rows.select("key", times.alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times")).orderBy("key").collect()
    step = sum(r["times"] for r in drawn) / cells
    out: list[int] = []
    passed, due = 0, step
    for r in drawn:
        passed += r["times"]
        if r["times"] >= 2 * step:  # a hot key: alone in its range
            out += [r["key"], r["key"] + 1]
        elif passed >= due:
            out.append(r["key"])
        while due <= passed:
            due += step
    return sorted(set(x for x in out if -(1 << 63) < x < 1 << 63))


def place(ranges: list[tuple[int, int, int, int, bool]], shards: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(shard, offset) of each (range, slice, bytes, rows, hot): near equal bytes, hot keys whole where they fit."""
    total = sum(r[2] for r in ranges)
    load, home = [0] * shards, {}
    hot: dict[int, list[tuple[int, int, int, int, bool]]] = {}
    for r in ranges:
        if r[4]:
            hot.setdefault(r[0], []).append(r)
    for _, own in sorted(hot.items(), key=lambda x: (-sum(r[2] for r in x[1]), x[0])):
        whole = sum(r[2] for r in own)
        at = min(range(shards), key=lambda s: (load[s], s))
        if load[at] + whole <= total / shards:
            load[at] += whole
            home |= {r[:2]: at for r in own}
        else:
            for r in sorted(own, key=lambda r: (-r[2], r[1])):
                at = min(range(shards), key=lambda s: (load[s], s))
                load[at] += r[2]
                home[r[:2]] = at
    rest = [r for r in sorted(ranges) if not r[4]]
    light = sum(r[2] for r in rest)
    room = [max(0.0, total / shards - x) for x in load]
    scale = light / (sum(room) or 1.0)
    edges, passed = [], 0.0
    for x in room:
        passed += x * scale
        edges.append(passed)
    passed = 0.0
    for r in rest:
        home[r[:2]] = min(bisect.bisect_left(edges, passed + r[2] / 2), shards - 1)
        passed += r[2]
    offset, out = [0] * shards, {}
    for r in sorted(ranges):
        at = home[r[:2]]
        out[r[:2]] = (at, offset[at])
        offset[at] += r[3]
    return out


class Ranges:
    """Splitters and slices as one broadcast row of arrays, so a plan holds none of their values."""

    def __init__(self, splitters: list[int], slices: list[int]) -> None:
        self.row = (splitters, slices)

    def beside(self, df: DataFrame, key: Column) -> tuple[DataFrame, Column, Column]:
        """``df`` with key and arrays beside each row, and a record's range and slice from its key and ``doc_id``."""
        name, own = free_name(df, "ranges"), free_name(df, "range_key")
        one = df.sparkSession.createDataFrame([(self.row,)], f"`{name}` struct<splitters:array<long>,slices:array<int>>")
        df = df.withColumn(own, key).crossJoin(F.broadcast(one))  # one row; the key is made once, below the join
        in_range = position(F.col(name)["splitters"], F.col(own)).cast("int")
        n = F.coalesce(F.get(F.col(name)["slices"], in_range), F.lit(1))
        by_id = F.pmod(F.xxhash64(df["doc_id"].cast("long"), F.lit(11)), F.greatest(n, F.lit(1)))
        by_key = F.pmod(F.xxhash64(F.col(own), F.lit(13)), F.greatest(-n, F.lit(1)))
        return df, in_range, F.when(n > 0, by_id).otherwise(by_key).cast("int")


def assigned(docs: DataFrame, scratch: Scratch, shards: int = 16) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]], Ranges]:
    """The narrow table (stored), the place of each range's slices, and what gives a record's range and slice from its key and id."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"), F.crc32(F.encode(F.col("text"), "utf-8")).alias("text_crc32"), key_of(F.col("text")).alias("key"))
    rows = scratch.store(narrow, "records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    cells = max(MIN_CELLS, min(MAX_CELLS, total // CELL_BYTES))
    splitters = splitters_of(rows, total, cells)
    # overfull ranges are cut into slices
    beside, in_range, _ = Ranges(splitters, []).beside(rows, rows["key"])
    sizes = beside.groupBy(in_range.alias("range")).agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    target = 2 * max(1, total // cells)
    parts = {r["range"]: (-(-r["bytes"] // target), r["lo"] == r["hi"]) for r in sizes if r["bytes"] > 2 * target}
    slices = [0 for _ in range(len(splitters) + 1)] if parts else []
    for r, (n, one) in parts.items():
        slices[r] = n if one else -n
    ranges = Ranges(splitters, slices)
    beside, in_range, in_slice = ranges.beside(rows, rows["key"])
    counted = beside.groupBy(in_range.alias("range"), in_slice.alias("slice")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    places = place([(r["range"], r["slice"], r["bytes"], r["rows"], parts.get(r["range"], (0, False))[1]) for r in counted], shards)
    return rows, places, ranges


def place_table(docs: DataFrame, places: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """A bounded table, a row for each slice of a range; broadcast on that ground."""
    return F.broadcast(docs.sparkSession.createDataFrame([(*k, *v) for k, v in places.items()], "range int, slice int, shard int, offset long"))


def shard_slots(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs(doc_id, text)``."""
    with Scratch(docs.sparkSession) as scratch:
        rows, places, ranges = assigned(docs, scratch, shards)
        scratch.keep(rows)
    beside, in_range, in_slice = ranges.beside(rows, rows["key"])
    ranged = beside.select("doc_id", "size", "text_crc32", "key", in_range.alias("range"), in_slice.alias("slice"))
    order = Window.partitionBy("range", "slice").orderBy("key", "doc_id", "size", "text_crc32")
    ranged = ranged.withColumn("n", F.row_number().over(order) - 1).join(place_table(docs, places), ["range", "slice"])
    return ranged.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with the column ``shard``, for a writer; the texts are not shuffled."""
    with Scratch(docs.sparkSession) as scratch:
        _, places, ranges = assigned(docs, scratch, shards)
    name, rng, part = (free_name(docs, x) for x in ("shard", "range_of", "slice_of"))
    beside, in_range, in_slice = ranges.beside(docs, key_of(docs["text"]))
    homes = place_table(docs, places).select(F.col("range").alias(rng), F.col("slice").alias(part), F.col("shard").alias(name))
    return beside.select(*docs.columns, in_range.alias(rng), in_slice.alias(part)).join(homes, [rng, part]).select(*docs.columns, name)
