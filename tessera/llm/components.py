"""Connected components of a table of undirected links, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Links of a node, or nodes of a label, from which on their rows don't go to one task; at most so many nodes and labels are hot.
LEAST_HOT, HOT = 2000, 1000
#: Tasks that a hot label's nodes are dealt to.
SPREAD = 1024


def connected_components(links: DataFrame, least_hot: int = LEAST_HOT) -> DataFrame:
    """links (a, b) -> (id, component), the least id reachable from each id.

    Each round takes the least label among a node's neighbours, then jumps
    to that label's own label, so the number of rounds grows with the
    logarithm of the diameter. Hot nodes are pre-aggregated before the
    shuffle; their labels, and those of labels that very many nodes have,
    are broadcast (HOT rows at most), so no node's links meet in one task.
    Links with a null end and self-links make no connection; an empty table
    gives an empty result.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    both = materialize(clean.select("a", "b").union(clean.select(F.col("b"), F.col("a"))).distinct())
    found = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count("*").alias("n")))
    cut = max(least_hot, -(-both.count() // HOT))
    hubs = materialize(found.where(F.col("n") >= cut).select("id"))
    hot_edges = both.join(F.broadcast(hubs.withColumnRenamed("id", "b")), "b", "left_semi").select("a", "b")
    edges = both.join(F.broadcast(hubs.withColumnRenamed("id", "b")), "b", "left_anti").select("a", "b")
    label, last = found.select("id", "component"), found
    while True:
        near = label.select(F.col("id").alias("b"), F.col("component").alias("near"))
        known = F.broadcast(near.join(F.broadcast(hubs.withColumnRenamed("id", "b")), "b"))
        told = edges.join(near, "b").select("a", "near").union(hot_edges.join(known, "b").select("a", "near"))
        seen = told.groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        hooked = label.join(seen, "id").select("id", "component", F.least("component", "near").alias("next"))
        many = label.groupBy(F.col("component").alias("next")).agg(F.count("*").alias("n")).where(F.col("n") >= cut).select("next")
        jump = label.select(F.col("id").alias("next"), F.col("component").alias("far"), F.lit(-1).alias("turn"))
        roots = F.broadcast(jump.join(F.broadcast(many), "next").select("next", F.col("far").alias("hot_far")))
        dealt = hooked.join(roots, "next", "left").withColumn("turn", F.when(F.col("hot_far").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")))
        moved = dealt.join(jump, ["next", "turn"], "left").select("id", F.least("next", F.coalesce("hot_far", "far")).alias("new"), F.col("component").alias("old"))
        moved = materialize(moved)
        release(last)
        label, last = moved.select("id", F.col("new").alias("component")), moved
        if moved.where("new <> old").isEmpty():
            release(both, hubs)
            label.written_to = moved.written_to
            return label
