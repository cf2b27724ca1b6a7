"""Operator 6: mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Targets. Sources, by code point with null last, have weights that repeat a cycle; together they get ``share`` of all words. No
source gets more than ``cap`` times its words: what is over goes to the others by weight until none is above (solved at once by
ordering the sources by the level at which they fill up).

Sample. With rate r = target / words of a source, each of its documents gets floor(r) whole copies for certain. What is left, p =
r - floor(r) of its words, is met by one more copy of a sample of fixed size. A source's documents are layered by size, four
layers an octave. From the largest layer down, each layer gets the number n of documents that brings the expected words nearest to
p of all words so far, so what one layer's whole number misses the next makes up; the first is rounded at random. In a layer of N
documents inclusion probabilities differ by size s: n s / sum(s) where n is at most half of N, else 1 - (N - n) (k - s) / sum(k - s)
with k the least plus the largest size; either way they are below 1 and sum to n. Documents are ranked by their random odds divided
by their inclusion odds, (u / (1 - u)) / (pi / (1 - pi)) with u from a hash of the id, and the n least are taken.

Scale. Layers are counted by an aggregate; the plan has a row for each source and layer, at most some 160 for a source. Ranks are
not sorted as a whole: rows are counted by layer and 4,096 intervals of the rank, and only the interval in which the n-th lies is
sorted, equal rows as one. So a source with a third of all rows is never one task's. A decision is a function of the row and its
line of the plan; texts are not shuffled.

Cases. A null text has size 0 and takes nothing. A null id's random number comes from its text. Rows equal in id and size are taken
together or not at all. A source without words takes nothing. An empty table gives an empty one. Same rows, same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, free_name, small

INTERVALS = 4096


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_of(key: Column) -> Column:
    """A number in (0, 1) from a text: 52 bits of md5."""
    return (F.conv(F.substring(F.md5(F.encode(key, "utf-8")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def draw_of(doc_id: Column, text: Column, seed: str) -> Column:
    """A document's random number: by its id, or by its text where it has none."""
    name = F.when(doc_id.isNull(), F.concat(F.lit("null-"), F.coalesce(text.cast("string"), F.lit("")))).otherwise(doc_id.cast("long").cast("string"))
    return random_of(F.concat(F.lit(f"{seed}-"), name))


def layer_of(size: Column) -> Column:
    """Four layers an octave: the place of the highest bit of ``size`` and the next two bits."""
    octave = F.length(F.bin(size)) - 1
    return (octave * 4 + F.call_function("shiftright", size * 4, octave) % 4).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``; a table with a row a source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights)).cast("int") + 1)
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * cap)
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * share
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    # the first source that does not fill up sets the level of all after it
    rows = rows.withColumn("level", F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole).getField("level"))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def layers_of(rows: DataFrame, goal: DataFrame, seed: str) -> DataFrame:
    """``(source, layer, n, of, total, ends)``: how many of a layer's documents are taken, and what their probabilities come from.

    ``rows(source, size, layer)``, ``goal(source, p)``; a layer has ``of`` documents of ``total`` words, ``ends`` is least plus largest.
    """
    size = F.col("size").cast("double")
    sums = rows.groupBy("source", "layer").agg(F.count("*").cast("double").alias("of"), F.sum(size).alias("total"), F.sum(size * size).alias("square"), (F.min(size) + F.max(size)).alias("ends"))
    start = random_of(F.concat(F.lit(f"{seed}-source-"), F.coalesce("source", F.lit("null"))))
    one = sums.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("layer", "of", "total", "square", "ends")), asc=False).alias("layers"))
    goal = goal.select(F.col("source").alias("goal_of"), "p")
    one = one.join(goal, F.col("source").eqNullSafe(F.col("goal_of"))).select("source", "layers", "p", start.alias("start"))
    taken = "array<struct<layer:int,n:double,of:double,total:double,ends:double>>"

    def step(acc: Column, x: Column) -> Column:
        cum = acc["cum"] + x["total"]
        n = F.greatest(F.lit(0.0), F.least(x["of"], F.floor((F.col("p") * cum - acc["words"]) * x["of"] / x["total"] + F.col("start")).cast("double")))
        out = F.struct(x["layer"].alias("layer"), n.alias("n"), x["of"].alias("of"), x["total"].alias("total"), x["ends"].alias("ends"))
        words = F.when(2 * n <= x["of"], n * x["square"] / x["total"]).otherwise(x["total"] - (x["of"] - n) * (x["ends"] * x["total"] - x["square"]) / (x["of"] * x["ends"] - x["total"]))
        return F.struct(cum.alias("cum"), (acc["words"] + words).alias("words"), F.concat(acc["out"], F.array(out)).alias("out"))

    zero = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("words"), F.expr(f"CAST(array() AS {taken})").alias("out"))
    return one.select("source", F.explode(F.aggregate("layers", zero, step).getField("out")).alias("l")).select("source", "l.*")


def rank_of(u: Column, size: Column, n: Column, of: Column, total: Column, ends: Column) -> Column:
    """The Pareto rank x / (1 + x), in [0, 1], of a document of a layer that is neither taken whole nor left out."""
    pi = F.when(2 * n <= of, n * size / total).otherwise(1 - (of - n) * (ends - size) / (of * ends - total))
    x = (u / (1 - u)) / (pi / (1 - pi))
    return x / (1 + x)


def cuts_of(ranked: DataFrame) -> DataFrame:
    """``(source, layer, cut)``: the last place of the order that is taken, from ``ranked(source, layer, n, rank, u, doc_id, size)``."""
    group, step = ["source", "layer"], F.least(F.lit(INTERVALS - 1), F.floor(F.col("rank") * INTERVALS))
    rows = ranked.withColumn("step", step)
    sums = rows.groupBy(*group, "step").agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("rows").over(Window.partitionBy(*group).orderBy("step")))
    ends = sums.where("upto >= n AND upto - rows < n").select(F.col("source").alias("s"), F.col("layer").alias("l"), F.col("step").alias("end"), (F.col("upto") - F.col("rows")).alias("before"))
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("layer") == F.col("l")) & (F.col("step") == F.col("end")))
    equal = inside.groupBy(*group, "rank", "u", "doc_id", "size").agg(F.count("*").alias("rows"), F.first("n").alias("n"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("rows").over(Window.partitionBy(*group).orderBy("rank", "u", "doc_id", "size"))
    at = F.struct("rank", "u", "doc_id", "size")
    return equal.withColumn("upto", upto).where("upto >= n").groupBy(*group).agg(F.min(at).alias("cut"))


def mix_plan(docs: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, cap: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """The narrow table ``(doc_id, source, size, layer, u)`` and the plan, a row for each source and layer (layer null: size 0); both stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("u"))
    rows = scratch.store(rows.withColumn("layer", F.when(F.col("size") > 0, layer_of(F.col("size")))), "sizes")
    sizes = scratch.store(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = targets(sizes, weights, share, cap)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.col("whole"))
    goal = scratch.store(goal, "targets")
    layers = scratch.store(layers_of(rows.where("size > 0"), goal, seed), "layers")
    drawn = small(layers.where("n > 0 AND n < of").select(F.col("source").alias("s"), F.col("layer").alias("l"), "n", "of", "total", "ends"))
    ranked = rows.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("layer") == F.col("l")))
    ranked = ranked.select("source", "layer", "n", rank_of(F.col("u"), F.col("size"), F.col("n"), F.col("of"), F.col("total"), F.col("ends")).alias("rank"), "u", "doc_id", "size")
    cuts = cuts_of(ranked).select(F.col("source").alias("s"), F.col("layer").alias("l"), "cut")
    plan = layers.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("layer") == F.col("l")), "left").drop("s", "l")
    empty = goal.select("source", *(F.lit(None).cast(t).alias(c) for c, t in plan.dtypes if c != "source"))
    plan = plan.unionByName(empty)
    goal = goal.select(F.col("source").alias("plan_of"), "source_size", "target", "whole")
    plan = goal.join(plan, F.col("source").eqNullSafe(F.col("plan_of"))).drop("source").withColumnRenamed("layer", "plan_layer")
    return rows, scratch.store(plan, "plan")


def copies_of(doc_id: Column, size: Column, u: Column, plan: dict[str, Column]) -> Column:
    """Copies that a row takes, from its line of the plan."""
    at = F.struct(rank_of(u, size, *(plan[c] for c in ("n", "of", "total", "ends"))).alias("rank"), u.alias("u"), doc_id.cast("long").alias("doc_id"), size.alias("size"))
    more = F.when(plan["n"] >= plan["of"], True).when(plan["cut"].isNull(), False).otherwise(at <= plan["cut"])
    return F.when(size > 0, plan["whole"] + more.cast("long")).otherwise(F.lit(0)).cast("int")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source)``."""
    with Scratch(docs.sparkSession) as scratch:
        rows, plan = map(scratch.keep, mix_plan(docs, scratch, weights, share, cap, seed))
    planned = rows.join(small(plan), F.col("source").eqNullSafe(F.col("plan_of")) & F.col("layer").eqNullSafe(F.col("plan_layer")))
    copies = copies_of(F.col("doc_id"), F.col("size"), F.col("u"), {c: F.col(c) for c in plan.columns})
    return planned.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns."""
    with Scratch(docs.sparkSession) as scratch:
        plan = scratch.keep(mix_plan(docs, scratch, weights, share, cap, seed)[1])
    line, own, times = (free_name(docs, x) for x in ("mix_plan", "mix_own", "mix_times"))
    lines = small(plan).select(F.struct("*").alias(line))
    size = words_of(docs["text"])
    sized = docs.withColumn(own, F.struct(size.alias("size"), F.when(size > 0, layer_of(size)).alias("layer"), draw_of(docs["doc_id"], docs["text"], seed).alias("u")))
    planned = sized.join(lines, sized["source"].cast("string").eqNullSafe(F.col(f"{line}.plan_of")) & F.col(f"{own}.layer").eqNullSafe(F.col(f"{line}.plan_layer")))
    copies = copies_of(F.col("doc_id"), F.col(f"{own}.size"), F.col(f"{own}.u"), {c: F.col(f"{line}.{c}") for c in plan.columns})
    return planned.withColumn(times, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
