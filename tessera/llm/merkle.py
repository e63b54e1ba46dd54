"""Merkle manifest of a table of documents, by a monoid of sparse forests (operator 13).

Leaves are hashes of rows, ranked by doc_id within their source; 16
consecutive nodes of a level become their hash, the last ones of a level as
many as there are. The roots of the sources are the leaves of one more tree.
How many nodes each level has follows from the counts alone, so of each run
of siblings it is known how many it has.

A fragment is a sparse forest: nodes whose run isn't whole yet, by tree,
level and index. Joining two fragments is the union of their nodes, after
which each run that is whole by then becomes its hash, and so on upwards.
That is associative, so fragments of partitions are merged by a tree of
rounds, those of neighbouring ranges first: these close each other's runs,
and a fragment never has more than a few nodes a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, materialize, partitions, release

#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run as a power of two (16); fragments that a round merges; levels of any tree at most; the tree of the sources' roots.
BITS, FAN, HIGHEST, TOP = 4, 64, 16, -1
#: Rows of the table of ranges up to which it is broadcast (about 60 bytes each); a larger one is joined.
RANGES = 200_000
#: Completed runs that a task holds before it passes them on.
HELD = 2000


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as -."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 (32 bytes) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*(encoded(fields[f]) for f in FIELDS)), 256))


def height(nodes: Column) -> Column:
    """Levels above the leaves of a tree with so many."""
    levels = F.lit(0)
    for k in range(HIGHEST - 1):
        levels = levels + (nodes > (1 << BITS * k)).cast("int")
    return levels


def level_count(nodes: int) -> int:
    count = 0
    while nodes > 1:
        nodes, count = -(-nodes >> BITS), count + 1
    return count


class Forest:
    """A fragment: the open runs, each with the nodes that it has so far, and what it has completed."""

    def __init__(self, trees: int):
        self.trees = trees
        self.open: dict[tuple[int, int, int], tuple[int, int, dict[int, bytes]]] = {}
        self.done: list[tuple[int, int, int, bytes]] = []

    def add(self, tree: int, nodes: int, level: int, index: int, digest: bytes, at: int) -> None:
        """One node of a tree of so many leaves; at: the range that it comes from. Completed runs become nodes in turn."""
        while True:
            width = -(-nodes >> BITS * level)
            if width == 1:  # the root of its tree
                if tree == TOP:
                    return
                tree, nodes, level, index = TOP, self.trees, 0, tree
                continue
            run, place = index >> BITS, index & (1 << BITS) - 1
            _, _, held = self.open.setdefault((tree, level, run), (nodes, at, {}))
            held[place] = digest
            size = min(1 << BITS, width - (run << BITS))
            if len(held) < size:
                return
            del self.open[tree, level, run]
            siblings = b"".join(held[k] for k in range(size))
            self.done.append((tree, level, run, siblings))
            digest = hashlib.sha256(siblings.hex().encode()).digest()
            level, index = level + 1, run

    def unresolved(self) -> list[tuple[int, int, int, int, int, int, bytes]]:
        return [(*key, place, nodes, at, digest) for key, (nodes, at, held) in self.open.items() for place, digest in held.items()]


#: A whole run (place is null), or a node of an open one.
NODES = "tree long, level int, run long, place int, nodes long, at long, digest binary"
_ARROW = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("run", pa.int64()), ("place", pa.int32()), ("nodes", pa.int64()), ("at", pa.int64()), ("digest", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def folded(nodes: DataFrame, trees: int) -> DataFrame:
    """nodes (tree, nodes, level, index, digest, at) of each partition as one fragment (NODES): whole runs, and what stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                forest.add(*row)
                if len(forest.done) >= HELD:
                    yield _batch([(*d[:3], None, None, None, d[3]) for d in forest.done])
                    forest.done = []
        yield _batch([(*d[:3], None, None, None, d[3]) for d in forest.done] + forest.unresolved())

    return nodes.select("tree", "nodes", "level", "index", "digest", "at").mapInArrow(run, NODES)


def tree_reduce(first: DataFrame, ranges: int, trees: int) -> list[DataFrame]:
    """All fragments merged, FAN neighbouring ones a round: written tables whose rows without a place are the runs."""
    rounds, width = [materialize(folded(first, trees))], 1
    while width < ranges or len(rounds) == 1:  # a range may have been read by many tasks
        width *= FAN
        index = F.shiftleft(F.col("run"), BITS) + F.col("place")
        left = rounds[-1].where("place is not null").select("tree", "nodes", "level", index.alias("index"), "digest", "at")
        near = left.repartition(max(1, -(-ranges // width)), F.floor(F.col("at") / width))
        rounds.append(materialize(folded(near, trees)))
    return rounds


@dataclass
class Manifest:
    """leaves: the rows' keys and hashes with tree (the source's rank), nodes, index; runs: all whole runs of siblings."""

    leaves: DataFrame
    runs: DataFrame
    trees: int
    deepest: int
    sources: DataFrame


def _ranked(hashed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with tree (rank of the source), nodes (its rows), index (rank in it) and at (their range); the sources; the number of ranges.

    Rows are sorted once, by ranges, so that a hot source lies in many of
    them; a rank is a row's place in its range and source plus the rows of
    the source in ranges before.
    """
    keys = ["source", "doc_id", "leaf"]
    # Within a partition monotonically_increasing_id counts rows one by one.
    ranged = hashed.repartitionByRange(partitions(hashed.sparkSession), *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.select("*", F.spark_partition_id().cast("long").alias("at"), F.monotonically_increasing_id().alias("row")))
    chunks = ranged.groupBy("at", "source").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    within = Window.partitionBy("source").orderBy("at")  # a row a range
    chunks = chunks.select("*", (F.sum("n").over(within) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("nodes"))
    chunks = materialize(chunks)
    begins = chunks.where("before = 0")
    ranges = begins.groupBy("at").agg(F.count("*").alias("sources"))
    ranges = ranges.select("at", (F.sum("sources").over(Window.orderBy("at")) - F.col("sources")).alias("earlier"))  # a row a range
    order = Window.partitionBy("at").orderBy("source")
    sources = begins.join(ranges, "at").select("source", "nodes", height(F.col("nodes")).alias("height"), (F.col("earlier") + F.row_number().over(order) - 1).alias("tree"))
    sources = materialize(sources)
    told = sources.select(F.col("source").alias("source_"), "height", "tree")
    placed = chunks.join(told, F.col("source").eqNullSafe(F.col("source_"))).select(F.col("at").alias("at_"), "source_", "first", "before", "nodes", "height", "tree")
    placed = materialize(placed)
    size = placed.agg(F.count("*").alias("n"), F.coalesce(F.max("at_") + 1, F.lit(0)).alias("ranges")).first()
    if size["n"] <= RANGES:
        placed = F.broadcast(placed)
    rows = ranged.join(placed, (F.col("at") == F.col("at_")) & F.col("source").eqNullSafe(F.col("source_")))
    return rows.select(*hashed.columns, "at", "tree", "nodes", "height", (F.col("row") - F.col("first") + F.col("before")).alias("index")), sources, size["ranges"]


def build(docs: DataFrame, tamper: Column | None = None) -> Manifest:
    """The manifest of docs. tamper: which rows also get the hash (column other) of their text with A-Z lower-cased.

    Columns of FIELDS that docs lacks count as null; other columns don't
    matter. Rows of a source ascend by doc_id (null first), those of equal
    doc_id by hash; equal rows are a leaf each. The null source is one of its
    own and the first. An empty table has no leaves and no root.
    """
    fields = {f: F.col(f) if f in docs.columns else F.lit(None).cast("string") for f in FIELDS}
    other = F.lit(None).cast("binary")
    if tamper is not None:
        other = F.when(tamper & fields["text"].isNotNull(), leaf_hash(fields | {"text": ascii_lower(fields["text"].cast("string"))}))
    hashed = materialize(docs.select(fields["doc_id"].cast("long").alias("doc_id"), fields["source"].cast("string").alias("source"), leaf_hash(fields).alias("leaf"), other.alias("other")))
    leaves, sources, ranges = _ranked(hashed)
    size = sources.agg(F.count("*").alias("trees"), F.coalesce(F.max("height"), F.lit(0)).alias("deepest")).first()
    nodes = leaves.select("tree", "nodes", F.lit(0).alias("level"), "index", F.col("leaf").alias("digest"), "at")
    rounds = tree_reduce(nodes, ranges, size["trees"])
    runs = rounds[0]
    for more in rounds[1:]:
        runs = runs.unionByName(more)
    release(hashed)
    return Manifest(leaves, runs.where("place is null").select("tree", "level", "run", F.col("digest").alias("siblings")), size["trees"], size["deepest"], sources)


def _paths(made: Manifest) -> DataFrame:
    """tree, run, path: for each run of leaves all runs on the way to the root, its own first (sources of one leaf: from the sources' tree on).

    From the top downwards, each run gets the path of the run that its parent
    is in; leaves are joined only to the last ones, which are 16 times fewer.
    """
    up = lambda c: F.shiftright(F.col(c), BITS)
    longer = lambda parent, runs: runs.join(parent, ["tree", "up"]).select("tree", "run", F.concat(F.array("siblings"), "path").alias("path"))
    at = lambda level: made.runs.where((F.col("level") == level) & (F.col("tree") >= 0)).select("tree", "run", "siblings", up("run").alias("up"))
    empty = F.array().cast("array<binary>")
    top = made.sources.sparkSession.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("run"), empty.alias("path"))
    for level in reversed(range(level_count(made.trees))):
        own = made.runs.where((F.col("level") == level) & (F.col("tree") == TOP)).select("tree", "run", "siblings", up("run").alias("up"))
        top = longer(top.withColumnRenamed("run", "up"), own)
    above = made.sources.withColumn("run", up("tree")).join(top.drop("tree"), "run") if made.trees > 1 else made.sources.select("*", empty.alias("path"))
    root = lambda level: above.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("run"), "path")
    paths = root(made.deepest)
    for level in reversed(range(made.deepest)):
        paths = longer(paths.withColumnRenamed("run", "up"), at(level)).unionByName(root(level))
    return paths


def proofs(made: Manifest) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, siblings for each leaf; digests as hex.

    siblings are the others of each run from the leaf's to the root's, each
    run's as one text; proof_sha256 hashes all of them. folded_root is the
    root again from the leaf (its other hash, if it has one) and the siblings.
    """
    ways = materialize(_paths(made))
    # Sources of one leaf have index 0 and so run 0, as their paths have.
    rows = made.leaves.withColumn("run", F.shiftright("index", BITS)).join(ways, ["tree", "run"])
    rows = rows.select("doc_id", "source", "tree", "index", "height", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("other")).alias("other"), F.transform("path", lambda run: F.lower(F.hex(run))).alias("path"))

    def step(run: Column, k: Column) -> Column:
        index = F.when(k < F.col("height"), F.call_function("shiftright", F.col("index"), k * BITS)).otherwise(F.call_function("shiftright", F.col("tree"), (k - F.col("height")) * BITS))
        place = F.pmod(index, F.lit(1 << BITS)).cast("int")
        return F.struct(F.left(run, place * 64).alias("before"), F.substr(run, place * 64 + 65).alias("after"))

    rows = rows.withColumn("steps", F.transform("path", step))
    fold = F.aggregate("steps", F.coalesce("other", "leaf"), lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]), 256))
    siblings = F.transform("steps", lambda s: F.concat(s["before"], s["after"]))
    rows = rows.select(
        "doc_id", "source", "leaf", F.when(F.col("height") == 0, F.col("leaf")).otherwise(F.sha2(F.get("path", F.col("height") - 1), 256)).alias("subroot"),
        F.when(F.size("path") == 0, F.col("leaf")).otherwise(F.sha2(F.get("path", F.size("path") - 1), 256)).alias("root"),
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), fold.alias("folded_root"), siblings.alias("siblings"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's proof; where 5 divides crc32(doc_id) the text is tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tamper = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return proofs(build(docs, tamper)).drop("source", "siblings")


def _oracle(deep: int = 7, top: int = 4) -> str:
    """SQL that folds level by level: sources of up to 16^deep leaves, up to 16^top sources."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    whole = lambda text: "sha256(" + " || ".join(part(f) for f in FIELDS[:-1]) + f" || {part(text)})"
    step = "lambda x, k: xor(x >> 1, 3988292384 * (x & 1))"
    crc = f"4294967295 - list_reduce(list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::INT, 2))::BIGINT), lambda c, b: list_reduce(range(8), {step}, xor(c, b)), 4294967295::BIGINT)"
    ctes = [
        f"rows AS (SELECT doc_id, source, {whole('text')} AS leaf, {whole('low')} AS other, {crc} AS crc FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, doc_id::VARCHAR AS s FROM documents))",
        "t0 AS (SELECT doc_id, source AS tree, leaf, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS cur, '' AS sib, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS sub FROM rows)",
        "a0 AS (SELECT tree, i, n, leaf AS d FROM t0)",
    ]

    def climb(name: str, levels: int, nodes: str) -> None:
        """Folds name0 and the nodes level by level."""
        for k in range(levels):
            ctes.append(f"{nodes}r{k} AS (SELECT tree, i // 16 AS run, list(d ORDER BY i) AS ds, any_value((n + 15) // 16) AS n FROM {nodes}{k} WHERE n > 1 GROUP BY tree, i // 16)")
            ctes.append(f"{nodes}{k + 1} AS (SELECT tree, run AS i, n, sha256(array_to_string(ds, '')) AS d FROM {nodes}r{k} UNION ALL SELECT tree, i, n, d FROM {nodes}{k} WHERE n = 1)")
            left, right = "array_to_string(ds[1:(t.i % 16)::INT], '')", "array_to_string(ds[(t.i % 16 + 2)::INT:], '')"
            ctes.append(
                f"{name}{k + 1} AS (SELECT doc_id, t.tree, leaf, CASE WHEN ds IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur, CASE WHEN ds IS NULL THEN sib ELSE sib || {left} || {right} END AS sib, "
                f"t.i // 16 AS i, CASE WHEN ds IS NULL THEN t.n ELSE r.n END AS n, sub FROM {name}{k} t LEFT JOIN {nodes}r{k} r ON t.tree IS NOT DISTINCT FROM r.tree AND t.i // 16 = r.run)"
            )

    climb("t", deep, "a")
    ctes.append(f"subs AS (SELECT tree AS source, d AS sub, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a{deep})")
    ctes.append("b0 AS (SELECT 0 AS tree, i, n, sub AS d FROM subs)")
    ctes.append(f"u0 AS (SELECT t.doc_id, 0 AS tree, t.leaf, t.cur, t.sib, s.i, s.n, s.sub FROM t{deep} t JOIN subs s ON t.tree IS NOT DISTINCT FROM s.source)")
    climb("u", top, "b")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, u.sub AS subroot, b.d AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = b.d AS verified FROM u{top} u CROSS JOIN b{top} b"


ORACLE = _oracle()
