"""Graph operators as DataFrame fixpoints: components, spanning forest, shortest paths, bands. (GRA-01..06, RES-01)

Each round's result is stored as a table, which cuts lineage; a round's table is deleted once the next one no longer reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """A stored copy in the shared folder (``spark.checkpoint.dir``; a local one only on a local master)."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def undirected(edges: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` in both directions, without loops, the least weight of each pair. (GRA-01)"""
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src <> dst")
    one = one.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return materialised(one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node that each end of an edge reaches. (GRA-03, RES-01)"""
    both = undirected(edges.withColumn("weight", F.lit(1.0))).select("src", "dst")
    labels = held = materialised(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        hooked = labels.join(near, labels["node"] == near["src"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("uc"))
        new = materialised(hooked.join(up, hooked["c"] == up["up"], "left").select("node", "old", F.least("c", F.coalesce("uc", "c")).alias("component")))
        discard(held)
        labels, held = new.select("node", "component"), new
        if new.where("old <> component").isEmpty():
            return labels


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float | None = None) -> DataFrame:
    """``(source, node, km)``: least path weight from each source to all it reaches, up to ``limit``. (GRA-04)

    Frontier relaxation: a round joins only nodes whose distance has just improved, so rounds are at most the longest
    best path in edges.
    """
    arcs = undirected(edges)
    best = materialised(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("km"), F.lit(True).alias("new")))
    while True:
        reached = best.where("new").join(arcs, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("km") + F.col("weight")).alias("km"))
        if limit is not None:
            reached = reached.where(F.col("km") <= limit)
        known = best.select("source", "node", "km", F.lit(False).alias("new"))
        both = known.union(reached.select("source", "node", "km", F.lit(True).alias("new")))
        # at equal distance the known row wins, so that the round ends
        new = materialised(both.groupBy("source", "node").agg(F.min(F.struct("km", "new")).alias("m")).select("source", "node", "m.km", "m.new"))
        discard(best)
        best = new
        if new.where("new").isEmpty():
            discard(arcs)
            return best.select("source", "node", "km")


def path_trees(edges: DataFrame, best: DataFrame) -> DataFrame:
    """``(source, node, km, prev)``: each node's predecessor on the shortest paths ``best(source, node, km)``, null at the source; the least one on a tie. (GRA-05)

    The arcs that achieve a distance are known from the distances, so one join gives them. Weights are positive.
    """
    before = best.select("source", F.col("node").alias("src"), F.col("km").alias("to_src"))
    tight = undirected(edges).join(best, F.col("dst") == F.col("node")).join(before, ["source", "src"]).where("to_src + weight = km AND to_src < km")
    prev = tight.groupBy("source", "node").agg(F.min("src").alias("prev"))
    return materialised(best.join(prev, ["source", "node"], "left").select("source", "node", "km", "prev"))


def unrolled(trees: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(source, node, pos, at)``: the nodes of the path of each of ``pairs(source, node)``, from the node (0) to the source. (GRA-05)

    Ancestors at doubling distances are stored; a place of a path is then found by its distance's binary digits, so rounds and joins
    grow with the logarithm of the longest path, and no path is gathered.
    """
    pairs = pairs.select("source", "node").distinct()
    own = trees.join(pairs.select("source").distinct(), "source", "left_semi")
    levels = [materialised(own.select("source", "node", F.coalesce("prev", "node").alias("anc"), F.col("prev").isNotNull().cast("long").alias("steps")))]
    while not levels[-1].where("anc <> source").isEmpty():
        far = levels[-1].select("source", F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("steps").alias("more"))
        levels.append(materialised(levels[-1].join(far, ["source", "anc"]).select("source", "node", F.col("far").alias("anc"), (F.col("steps") + F.col("more")).alias("steps"))))
    rows = pairs.join(levels[-1].select("source", "node", "steps"), ["source", "node"])
    rows = rows.select("source", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))).alias("pos"), F.col("node").alias("at"))
    for k, level in enumerate(levels):
        jump = level.select("source", F.col("node").alias("at"), F.col("anc").alias("to"))
        rows = rows.join(jump, ["source", "at"]).select("source", "node", "pos", F.when(F.col("pos").bitwiseAND(1 << k) != 0, F.col("to")).otherwise(F.col("at")).alias("at"))
    out = materialised(rows)
    discard(*levels)
    return out


def spanning_forest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The minimum spanning forest ``(src, dst, weight)`` by Boruvka rounds; ties go to the least (src, dst). (GRA-02)

    The total order makes it the forest that sorted edges taken one by one would give.
    """
    return grown_forest(edges, nodes.select("node", F.col("node").alias("component")))[0]


def grown_forest(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the minimum spanning forest takes of ``edges`` once lighter ones have joined ``labels(node, component)``, and the labels after it. (GRA-02)"""
    one = materialised(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    labels = materialised(labels.select("node", "component"))
    chosen = None
    while True:
        a, b = labels.select(F.col("node").alias("src"), F.col("component").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
        across = one.join(a, "src").join(b, "dst").where("ca <> cb")
        pick = F.min(F.struct("weight", "src", "dst")).alias("m")
        ends = across.select(F.col("ca").alias("c"), "weight", "src", "dst").union(across.select(F.col("cb").alias("c"), "weight", "src", "dst"))
        picked = materialised(ends.groupBy("c").agg(pick).select("m.src", "m.dst", "m.weight").distinct())
        if picked.isEmpty():
            return (chosen if chosen is not None else one.where("false")), labels
        chosen = picked if chosen is None else chosen.union(picked)
        joined = connected_components(picked.join(a, "src").join(b, "dst").select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        labels = materialised(labels.join(joined.select(F.col("node").alias("old"), F.col("component").alias("merged")), labels["component"] == F.col("old"), "left").select("node", F.coalesce("merged", "component").alias("component")))
