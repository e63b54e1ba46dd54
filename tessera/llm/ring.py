"""Sharding on a consistent-hash ring with bounded loads (operator 9).

Every shard has virtual nodes on a ring of 2^32 places. A document's key is
its text, so that equal texts belong together; it goes to the first virtual
node at or after its place. Shards hold at most their capacity: keys that
overflow a full shard continue clockwise to the next virtual node of a shard
that has room. Capacities add up to the number of documents, so all shards
end up full and their counts are at most one apart. The walk is done on
counts of virtual nodes, not on documents, by prefix sums along the ring; a
hot key is ranked in lanes, and only where its rank crosses a shard's
capacity is it split. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release

#: Places on the ring, and the places of one cell of the index of virtual nodes.
RING, CELL = 1 << 32, 1 << 20


def _place(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """Virtual nodes in ring order: arc, shard, node, place, and the arc (after, place] that they take."""
    made = spark.range(shards * nodes, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("node")
    )
    placed = made.withColumn("place", _place(F.concat_ws("/", F.lit("shard"), "shard", "node")))
    order = Window.orderBy("place", "shard", "node")  # as many rows as the ring has nodes
    return placed.withColumn("arc", F.row_number().over(order) - 1).withColumn("after", F.lag("place", 1, -1).over(order))


def _routes(arcs: DataFrame, shards: int, total: int) -> DataFrame:
    """From arcs (arc, shard, n) the stretches of ranks of each arc and the shards and slots they go to.

    Shards take their own arcs' keys first, in ring order, up to their
    capacity; what room is left to a shard goes to its virtual nodes that
    are asked for some, in ring order, and the rest to all evenly. Keys over capacity continue clockwise, and a place that is free takes
    those that came last: so most stay near, and what changes somewhere on the
    ring changes little elsewhere. From where none are under way, the number of
    those under way goes up and down along the ring; a key gets the next place
    at which that number falls below what it was when the key set out. All
    windows are over the ring's nodes.
    """
    size, more = divmod(total, shards)
    own = Window.partitionBy("shard").orderBy("arc")
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shard = Window.partitionBy("shard")
    held = arcs.coalesce(1).withColumn("most", F.lit(size) + (F.col("shard") < more).cast("long")).withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("most") - ahead("n", own))))
    held = held.withColumn("over", F.col("n") - F.col("kept")).withColumn("free", F.col("most") - F.sum("kept").over(shard))
    held = held.withColumn("nodes", F.count("*").over(shard)).withColumn("turn", F.row_number().over(own) - 1)
    # A node's own demand is what comes from the full nodes right before it, back to the last one with room.
    ring_, open_ = Window.partitionBy(), (F.col("free") > 0).cast("int")
    gap = F.pmod(F.coalesce(F.sum(open_).over(Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.greatest(F.lit(1), F.sum(open_).over(ring_)))
    held = held.withColumn("gap", gap).withColumn("asked", F.when(F.col("free") > 0, F.sum("over").over(Window.partitionBy("gap"))).otherwise(0))
    held = held.withColumn("first", F.greatest(F.lit(0), F.least("asked", F.col("free") - ahead("asked", own)))).withColumn("rest", F.col("free") - F.sum("first").over(shard))
    held = held.withColumn("room", F.col("first") + F.floor(F.col("rest") / F.col("nodes")) + (F.col("turn") < F.col("rest") % F.col("nodes")).cast("long"))
    # How many are under way after a node, if none were before the first: least where the line begins.
    step = F.col("over") - F.col("room")
    held = held.withColumn("under_way", F.sum(step).over(Window.orderBy("arc")))
    held = held.withColumn("begin", F.min_by("arc", F.struct("under_way", "arc")).over(ring_)).withColumn("at", F.pmod(F.col("arc") - F.col("begin") - 1, F.count("*").over(ring_)))
    held = materialize(held.withColumn("after", F.sum(step).over(Window.orderBy("at"))).select("arc", "shard", "kept", "over", "room", "at", F.least("after", F.col("after") - step).alias("low"), F.greatest("after", F.col("after") - step).alias("high")))
    # A node either sends keys on or has room. Between two of the numbers that are met along the line, keys and places take turns.
    met = held.select(F.explode(F.array("low", "high")).alias("p")).distinct().coalesce(1)
    met = materialize(met.select("p", (F.row_number().over(Window.orderBy("p")) - 1).alias("band"), F.lead("p").over(Window.orderBy("p")).alias("end")))
    band = lambda name, end: F.broadcast(met.select(F.col("p").alias(end), F.col("band").alias(name)))
    turns = held.where("low < high").join(band("first", "low"), "low").join(band("last", "high"), "high")
    turns = turns.select("arc", "shard", "kept", "room", "at", "low", F.explode(F.sequence("first", F.col("last") - 1)).alias("band"))
    sent = F.lag(F.struct("arc", "kept", "low")).over(Window.partitionBy("band").orderBy("at"))
    moved = turns.withColumn("sent", sent).where("room > 0").join(F.broadcast(met), "band")
    since = F.col("sent.kept") - F.col("sent.low")
    moved = moved.groupBy("sent.arc", "shard", "at").agg(F.min(since + F.col("p")).alias("lo"), F.max(since + F.col("end")).alias("hi")).select("arc", "lo", "hi", "shard")
    taken = held.where("kept > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("kept").alias("hi"), "shard").unionByName(moved)
    slots = Window.partitionBy("shard").orderBy("arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    routes = materialize(taken.coalesce(1).withColumn("first_slot", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(slots), F.lit(0))))
    release(held, met)
    return routes


def assign_shards(docs: DataFrame, shards: int = 24, nodes: int = 64, lane_rows: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of documents (doc_id, text).

    The law is rows: counts of shards are at most one apart. Size is the
    bytes of the text plus 8. Null texts have no bytes and the key of the
    empty text; rows without or with equal doc_ids are rows like any other,
    ordered by what they hold. Other columns are ignored; an empty table
    gives an empty result.

    Lanes come from doc_id, and for rows without one from the order in which
    they are read, so that no lane grows with them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _place(text).alias("key"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("nth"),
    )
    keys = materialize(keys)
    nodes_ = ring(spark, shards, nodes)
    # Which arc a key is in: arcs are listed by the cells that they touch (at most RING / CELL + nodes rows).
    wrap = nodes_.groupBy().agg(F.max("place").alias("after"), F.min_by("arc", "place").alias("arc")).select("arc", "after", F.lit(RING - 1).alias("place"))
    arcs = nodes_.select("arc", "after", "place").union(wrap).where("place > after")
    index = arcs.select("arc", "after", "place", F.explode(F.sequence(F.floor((F.col("after") + 1) / CELL), F.floor(F.col("place") / CELL))).alias("cell"))
    found = keys.withColumn("cell", F.floor(F.col("key") / CELL)).join(F.broadcast(index), "cell").where("key > after and key <= place")
    far = F.pmod(F.col("key") - F.col("after"), F.lit(RING))
    # A key's documents are ranked in lanes, as many as the number of rows asks for.
    rows = keys.count()
    lanes = max(16, -(-rows // (shards * nodes * lane_rows)))
    part = F.floor(far * 4 / (RING / (shards * nodes)))
    lane = F.pmod(F.xxhash64("doc_id", "nth"), F.lit(lanes))
    found = found.select("doc_id", "size", "text_crc32", "key", "arc", (part * lanes + lane).cast("long").alias("lane"))
    counts = found.groupBy("arc", "lane").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    ahead = Window.partitionBy("arc").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    loads = materialize(nodes_.join(counts.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n")).coalesce(1))
    routes = _routes(loads.coalesce(1), shards, rows)
    within = Window.partitionBy("arc", "lane").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = found.withColumn("place", F.row_number().over(within) - 1).join(starts, ["arc", "lane"]).withColumn("rank", F.col("ahead") + F.col("place"))
    # At most three routes for each virtual node.
    sent = ranked.join(F.broadcast(routes), "arc").where("rank >= lo and rank < hi")
    return sent.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
