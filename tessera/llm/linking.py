"""Links near-duplicate documents by sketches of their shingle sets.

A sketch gives each document a row of 16-bit values that agree more often
the more alike two sets are. Bands of values bring candidates together, an
estimate over both sketches rules out hopeless pairs, and every link is
confirmed on the full sets, whose shingles 128-bit hashes tell apart.

Groups of any size are safe: documents with equal sets are one class, and the
classes of a bucket are first linked with the most central one alone. Buckets
whose members then lie in one component are done. In the others, members
outside the main component are held against all members in blocks; only what
could still join two components is confirmed, so no task gets more than two
blocks, and a block gives no more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, column_buffer, materialize, might_be_in, release
from .components import connected_components
from .shingles import in_common, minima, mix, permutations, wide_sets

#: Standard deviations below the threshold at which an estimate rules a pair out.
DOUBT = 5.0
#: Members of a bucket in a block.
BLOCK = 256


class Sketch(Protocol):
    #: Values of a sketch, and the seed of their hash functions.
    values: int
    seed: int

    def encode(self, least: np.ndarray) -> np.ndarray:
        """Values (texts x values, 16 bits) from the least permuted hashes."""

    def likeness(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarities of pairs of sketches; n: sizes of their sets."""


def band_rows(threshold: float, values: int, miss: float = 1e-6) -> int:
    """Most values a band may hold so that a pair at the threshold is missed with at most that chance."""
    fits = [r for r in range(1, 13) if (1 - threshold**r) ** (values // r) <= miss]
    return max(fits, default=1)


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _sketches(sketch: Sketch, ngram: int):
    a, b = permutations(sketch.values, sketch.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            data, offsets = column_buffer(batch.column(1))
            sets = wide_sets(data, offsets, ngram)
            n = np.array([x.shape[1] for x in sets], np.int64)
            bounds = np.concatenate(([0], np.cumsum(n)))
            hashes, others = (np.concatenate([*(x[k] for x in sets), np.zeros(0, np.uint64)]) for k in (0, 1))
            sums = np.zeros((2, len(n)), np.uint64)
            if len(at := np.flatnonzero(n)):
                sums[0, at] = np.add.reduceat(mix(hashes + np.uint64(1)), bounds[at])
                sums[1, at] = np.add.reduceat(mix(others + np.uint64(1)), bounds[at])
            values = sketch.encode(minima(hashes, bounds, a, b))
            columns = [batch.column(0).cast(pa.int64()), pa.array(n), *(pa.array(x.view(np.int64)) for x in sums), _binary(list(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return run


def _bands(sketch: Sketch, rows: int):
    """(id, sketch) to (id, band, key): bands of values as 64 bits, made anew where they are needed, since they take as much room as the sketch."""
    fold = permutations(rows, sketch.seed + 1)[0]
    bands = sketch.values // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 12):
                ids, raw = (batch.column(k).slice(lo, 1 << 12) for k in range(2))
                values = np.frombuffer(b"".join(raw.to_pylist()), np.uint16).reshape(-1, sketch.values)
                parts = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
                keys = mix((parts * fold).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                columns = [pa.array(np.repeat(ids.to_numpy(), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(values))), pa.array(keys.view(np.int64).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "band", "key"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = in_common(x, y)
    return 100 * both >= percent * (x.shape[1] + y.shape[1] - both)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: a sixth of the room of their sets, which are made anew where they are compared."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in by_bytes(batches, 1):
        data, offsets = column_buffer(batch.column(1))
        raw = data.tobytes()
        rows = [pack.compress(raw[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], names=["id", "text"])


def _sets(packed: list[bytes], ngram: int) -> list[np.ndarray]:
    """Full sets of compressed texts, some bytes of text at a time."""
    unpack, out, held, size = zstandard.ZstdDecompressor(), [], [], 0

    def flush() -> None:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in held], dtype=np.int64)))
        out.extend(wide_sets(np.frombuffer(b"".join(held), np.uint8), offsets, ngram))
        held.clear()

    for row in packed:
        held.append(unpack.decompress(row))
        size += len(held[-1])
        if size >= 1 << 20:
            flush()
            size = 0
    flush()
    return out


def _likely(sketch: Sketch, percent: int):
    spread = DOUBT * np.sqrt(percent / 100 * (1 - percent / 100) / sketch.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b, r_a, r_b = (batch.column(k) for k in range(6))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, sketch.values) for c in (r_a, r_b))
            n_x, n_y = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (n_a, n_b))
            j = sketch.likeness(x, y, n_x, n_y)
            keep = pa.array((j >= percent / 100 - spread) & (np.minimum(n_x, n_y) * 100 >= percent * np.maximum(n_x, n_y)))
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _confirmed(ngram: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                sides = (_sets(batch.column(k).to_pylist(), ngram) for k in (2, 3))
                mask = pa.array([_linked(p, q, percent) for p, q in zip(*sides, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by their first three columns, a group at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


#: A member of a bucket in a pair of blocks; side 0: outside the main component.
MEMBER = "key long, i int, j int, side int, id long, component long, band int"


class _Cell:
    """Two blocks of a bucket's members: rows of MEMBER, n, sketch and main."""

    def __init__(self, group: list[tuple], sketch: Sketch, rows: int, percent: int):
        self.sides = [[r for r in group if r[3] == k] for k in (0, 1)]
        self.values = [np.frombuffer(b"".join(r[8] for r in s), np.uint16).reshape(-1, sketch.values) for s in self.sides]
        self.n = [np.array([r[7] for r in s], np.float64) for s in self.sides]
        self.ids, self.of = ([np.array([r[k] for r in s], np.int64) for s in self.sides] for k in (4, 5))
        self.band, self.main = group[0][6], group[0][9]
        self.sketch, self.rows, self.share = sketch, rows, percent / 100
        self.cut = self.share - DOUBT * np.sqrt(self.share * (1 - self.share) / sketch.values)

    def near(self, k: int) -> np.ndarray:
        """Members of side 1 that may be linked with the k-th of side 0 and lie in another component.

        A pair counts in the first band that it shares, and on one side only.
        """
        x, y, n, of, one = self.values[0][k], self.values[1], self.n[0][k], self.of[0][k], self.ids[0][k]
        fits = (self.of[1] != of) & ((self.of[1] == self.main) | (self.ids[1] > one))
        at = np.flatnonzero(fits & (np.minimum(self.n[1], n) >= self.share * np.maximum(self.n[1], n) - 1e-9))
        equal = y[at] == x
        close = equal.mean(1) >= self.cut
        at, equal = at[close], equal[close]
        if len(at):
            at = at[equal[:, : self.sketch.values // self.rows * self.rows].reshape(len(at), -1, self.rows).all(2).argmax(1) == self.band]
        if len(at):
            at = at[self.sketch.likeness(np.repeat(x[None], len(at), 0), y[at], np.full(len(at), n), self.n[1][at]) >= self.cut]
        return at


def _possible(sketch: Sketch, rows: int, percent: int):
    """Members that may be linked with one of another component, by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            cell = _Cell(group, sketch, rows, percent)
            hit: set[int] = set()
            for k, row in enumerate(cell.sides[0]):
                if len(at := cell.near(k)):
                    out.append(row[:7])
                    hit.update(at.tolist())
            out += [cell.sides[1][k][:7] for k in sorted(hit)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], pa.int64() if k in (0, 4, 5) else pa.int32()) for k in range(7)], names=[c.split()[0] for c in MEMBER.split(", ")]
        )

    return run


def _joined(sketch: Sketch, rows: int, ngram: int, percent: int):
    """Links between members of different components, confirmed on their full sets; at most one for each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for group in _groups(batches):
            cell = _Cell(group, sketch, rows, percent)
            sets = [_sets([r[10] for r in s], ngram) for s in cell.sides]
            up: dict[int, int] = {}

            def top(c: int, up=up) -> int:
                while c in up:
                    c = up[c]
                return c

            for k, x in enumerate(sets[0]):
                for m in cell.near(k).tolist():
                    a, b = top(cell.sides[0][k][5]), top(cell.sides[1][m][5])
                    if a == b:
                        continue
                    if _linked(x, sets[1][m], percent):
                        links.append(tuple(sorted((cell.sides[0][k][4], cell.sides[1][m][4]))))
                        up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def near_components(docs: DataFrame, sketch: Sketch, ngram: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of
    their sets of distinct shingles of ngram words; component_id is the
    least doc_id reachable, and kept marks the rows that bear it. One row
    comes back for each input row.

    Null or empty texts have no shingles and are linked with nothing; rows
    with a null doc_id are linked with nothing and have a null component.
    Rows that share a doc_id are one document with several texts. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = band_rows(percent / 100, sketch.values)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"
    sketched = materialize(texts.mapInArrow(_sketches(sketch, ngram), schema))

    # One document of each class of equal sets; only those that may be in a class of several need a join.
    whole = ["h1", "h2", "n_shingles"]
    classes = materialize(sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*whole).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    some = might_be_in(sketched.where("n_shingles > 0 and doc_id is not null"), "h1", classes.where("n > 1").select("h1"))
    first = some.where("__maybe").join(classes.select(F.col("id").alias("doc_id"), *whole), ["doc_id", *whole], "left_semi")
    lone = some.where("not __maybe").select("doc_id", "sketch").unionByName(first.select("doc_id", "sketch"))
    lone = materialize(lone.select(F.col("doc_id").alias("id"), "sketch"))
    # Only keys that several documents may have are shuffled with their documents.
    banded = lone.mapInArrow(_bands(sketch, rows), "id long, band int, key long")
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = materialize(might_be_in(banded, "key", shared.select("key")).where("__maybe").drop("__maybe").join(shared, "key"))
    release(lone, shared)
    central = members.groupBy("id").agg(F.sum("size").alias("weight"))
    weighed, plain = materialize(members.join(central, "id").select("key", "band", "id", "weight")), members
    release(plain)
    members = weighed

    ids = materialize(members.select("id").distinct())
    likely = might_be_in(texts.where("doc_id is not null"), "doc_id", ids).where("__maybe").drop("__maybe")
    full = materialize(likely.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_packed, "id long, text binary"))
    brief = might_be_in(sketched.select("doc_id", "n_shingles", "sketch"), "doc_id", ids).where("__maybe").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    brief = materialize(brief)

    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side(brief, "a", "n", "sketch"), "a").join(side(brief, "b", "n", "sketch"), "b")
        near = near.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_likely(sketch, percent), "a long, b long")
        sure = near.join(side(full, "a", "text"), "a").join(side(full, "b", "text"), "b")
        return sure.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(ngram, percent), "a long, b long").distinct()

    rank = F.struct("weight", (-F.col("id")).alias("least"))
    pivots = members.groupBy("key").agg(F.max_by("id", rank).alias("pivot"))
    star = members.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    links = materialize(confirmed(star.distinct()))
    component = connected_components(links)
    release(links)

    now = members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    unsettled = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("component", rank).alias("main"), F.count("*").alias("all")).where("lo <> hi")
    now = materialize(now.join(unsettled.select("key", "main", "all"), "key").select("key", "band", "id", "component", "main", "all"))
    if not now.isEmpty():
        outer = now.where("component <> main")
        sizes = outer.groupBy("key").agg(F.count("*").alias("outside"))
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        place = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        left = outer.join(sizes, "key").select("key", place("outside").alias("i"), every("all").alias("j"), F.lit(0).alias("side"), "id", "component", "band", "main")
        right = now.join(sizes, "key").select("key", every("outside").alias("i"), place("all").alias("j"), F.lit(1).alias("side"), "id", "component", "band", "main")
        cells = ["key", "i", "j"]
        columns = [c.split()[0] for c in MEMBER.split(", ")]
        sketches = left.union(right).join(brief, "id").select(*columns, "n", "sketch", "main").repartition(*cells).sortWithinPartitions(*cells)
        possible = materialize(sketches.mapInArrow(_possible(sketch, rows, percent), MEMBER))
        told = possible.join(brief, "id").join(full, "id").join(unsettled.select("key", "main"), "key")
        told = told.select(*columns, "n", "sketch", "main", "text").repartition(*cells).sortWithinPartitions(*cells)
        more = materialize(told.mapInArrow(_joined(sketch, rows, ngram, percent), "a long, b long"))
        if not more.isEmpty():
            before, component = component, connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
            release(before)
        release(possible, more)
    release(members, ids, full, brief, now)

    labelled = classes.join(component, "id", "left").select(*whole, F.coalesce("component", "id").alias("component_id"))
    joined = sketched.select("doc_id", "n_shingles", "h1", "h2").join(labelled, whole, "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", known.alias("component_id"), F.coalesce(F.col("doc_id") == known, F.lit(True)).alias("kept"))
