"""Approximate nearest neighbours by an inverted file with product quantisation (operator 5).

Coarse centroids part the vectors into lists; a vector's residual to its
centroid is kept as one code for each subspace. A query probes the lists
whose centroids have the largest inner product with it, adds up its distance
tables over the codes there, and reranks on the original vectors all that can
be among the best, whatever the codes' errors; so within the lists probed the
result is exact. How many lists are probed is measured: the fewest that reach
the recall wanted on the sample that the index is fitted on. There are as
many lists as the square root of the number of vectors. Lists of any size are
dealt in blocks; a block's queries stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Vectors that the index is fitted on at most, of which so many try how many lists are to be probed for the recall wanted.
SAMPLE, TRIED, RECALL = 20_000, 400, 0.96
#: Vectors of the sample for each list at least (more lists would be no clusters of the sample); lists probed at least.
A_LIST, PROBES = 8, 4
#: Subspaces, codes of each, vectors of a block, queries held against it at once; pairs that are reranked at once.
SUBSPACES, CODES, BLOCK, QUERIES, PAIRS = 16, 256, 4096, 256, 1 << 16
SEED = 7


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Centroids of at most k clusters; empty ones are begun anew at the points that fit worst."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    if len(points) <= k:
        return points
    centroids = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near, far = nearest(x, centroids)
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        held = np.flatnonzero(count)
        centroids[held] = np.add.reduceat(x[order], np.cumsum(count)[held] - count[held]) / count[held, None]
        if len(lone := np.flatnonzero(count == 0)):
            centroids[lone] = x[np.argsort(-far, kind="stable")[: len(lone)]]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centroid."""
    parts = []
    for k in range(0, max(len(x), 1), BLOCK):
        d = (centroids * centroids).sum(1)[None] - 2 * x[k : k + BLOCK] @ centroids.T
        near = d.argmin(1)
        parts.append((near, d[np.arange(len(near)), near] + (x[k : k + BLOCK] ** 2).sum(1)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Index:
    centroids: np.ndarray
    spans: list[tuple[int, int]]
    codebooks: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists, _ = nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        return lists, np.stack([nearest(rest[:, a:b], book)[0] for (a, b), book in zip(self.spans, self.codebooks, strict=True)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Inner products of queries with each code of each subspace."""
        return [queries[:, a:b] @ book.T for (a, b), book in zip(self.spans, self.codebooks, strict=True)]

    def errors(self, k: int, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors of list k to what their codes stand for."""
        told = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], 1)
        return np.sqrt(((x - self.centroids[k] - told) ** 2).sum(1))


def fit(sample: np.ndarray, lists: int) -> Index:
    centroids = kmeans(sample, lists)
    rest = sample - centroids[nearest(sample, centroids)[0]]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return Index(centroids, spans, [kmeans(rest[:, a:b], CODES) for a, b in spans])


def probes_for(index: Index, sample: np.ndarray, top: int, recall: float = RECALL, tried: int = TRIED) -> int:
    """The fewest lists that hold the share recall of the top vectors of the sample, over the first of them as queries.

    A sample's nearest vectors are farther off than those of all vectors, and
    harder to find, so the measure errs towards more lists.
    """
    own, _ = nearest(sample, index.centroids)
    needed = []
    for k in range(0, min(tried, len(sample)), QUERIES):
        q = sample[k : k + QUERIES][: tried - k]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(k, k + len(q))] = -np.inf
        if len(sample) > top + 1:
            best = np.argpartition(-score, top, axis=1)[:, :top]
        else:
            best = np.argsort(-score, axis=1)[:, : max(len(sample) - 1, 1)]
        place = np.argsort(np.argsort(-(q @ index.centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
        needed.append(np.take_along_axis(place, own[best], 1).ravel())
    needed = np.sort(np.concatenate(needed))
    return min(len(index.centroids), max(PROBES, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1))


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of pairs (n x d each), summed in the order of components, so equal vectors score equal."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        total += queries[:, k] * vectors[:, k]
    return total


def reaching(score: np.ndarray, error: np.ndarray, top: int) -> np.ndarray:
    """Which of a row's scores, each wrong by at most its error, can be among the row's top."""
    if score.shape[1] <= top:
        return np.isfinite(score)
    low = score - error
    least = -np.partition(-low, top - 1, axis=1)[:, top - 1, None]
    return (score + error >= least) & np.isfinite(score)


def _stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one number of components each, none of them null, as rows."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


class Block:
    """Vectors of one list, in order of their ids, against which queries are held."""

    def __init__(self, index: Index, k: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, top: int):
        order = np.argsort(ids, kind="stable")
        self.index, self.centroid, self.top = index, index.centroids[k], top
        self.ids, self.x, self.codes = ids[order], x[order], codes[order]
        self.error, self.size = index.errors(k, self.x, self.codes), np.sqrt((self.x * self.x).sum(1))

    def best(self, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of each query's top here; exact."""
        ids, x = self.ids, self.x
        long = np.sqrt((q * q).sum(1))[:, None]
        slack = 1e-9 * long * (self.size + self.error + np.sqrt((self.centroid**2).sum()))  # of rounding
        loose = 1e-5 * long * (self.size + self.error)  # of tables in single precision
        score = np.repeat((q @ self.centroid).astype(np.float32)[:, None], len(ids), 1)
        for m, table in enumerate(self.index.tables(q)):
            score += table.astype(np.float32)[:, self.codes[:, m]]
        own = q_ids[:, None] == ids[None]
        score[own] = -np.inf
        near = reaching(score, long * self.error + slack + loose, self.top)
        cols = np.flatnonzero(near.any(0))
        score = np.where(near[:, cols], q @ x[cols].T, -np.inf)
        row, col = np.nonzero(reaching(score, slack[:, cols], self.top))
        col = cols[col]
        exact = np.concatenate([inner_products(q[row[k : k + PAIRS]], x[col[k : k + PAIRS]]) for k in range(0, max(len(row), 1), PAIRS)])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.top
        return q_ids[row[best]], ids[col[best]], exact[best]


def _search(index: Index, top: int):
    """Rows sorted by list, block and side (vectors before queries): id, vector and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            lists, blocks, sides, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            bounds = np.flatnonzero((np.diff(lists) != 0) | (np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *bounds], [*bounds, batch.num_rows], strict=True):
                if a == b:
                    continue
                if (now := (lists[a], blocks[a])) != key:
                    key, held, block = now, [], None
                x = _stacked(batch.column(4).slice(a, b - a))
                if sides[a] == 0:
                    held.append((ids[a:b].astype(np.int64), x, np.frombuffer(b"".join(batch.column(5).slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)))
                    continue
                if not held:
                    continue
                if block is None:
                    block = Block(index, int(key[0]), *(np.concatenate(c) for c in zip(*held, strict=True)), top)
                for k in range(0, b - a, QUERIES):
                    found = block.best(ids[a + k : min(b, a + k + QUERIES)].astype(np.int64), x[k : k + QUERIES])
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that can take part.

    Vectors that are null, zero, empty, or hold null or non-finite components
    take none, nor do rows without a vec_id.
    """
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return fine.where(~F.exists("embedding", odd) & F.exists("embedding", lambda v: v != 0))


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame | None = None, top: int = 20, recall: float = RECALL) -> DataFrame:
    """The top nearest vectors of each query: query_id, rank, vec_id, score.

    vectors and queries: vec_id, embedding; a query's own vec_id is no
    candidate. Queries default to the vectors whose vec_id is divisible by
    20. score is the inner product in double precision on the original
    vectors; equal scores rank the smaller vec_id first. recall: what the
    probes have to reach on the sample. See usable for the rows that take
    part; a vector of another number of components than a query's has no
    inner product with it, so each number has an index of its own. Of queries
    that share a vec_id the least vector counts. Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = usable(vectors)
    asked = usable(queries) if queries is not None else rows.where("vec_id % 20 = 0")
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    # One row for each number of components.
    sizes = sorted((r["size"], r["count"]) for r in rows.groupBy(F.size("embedding").alias("size")).count().collect())
    found = None
    for size, n in sizes:
        part = _search_in(rows.where(F.size("embedding") == size), asked.where(F.size("query") == size), n, top, recall)
        found = part if found is None else found.union(part)
    return vectors.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def _search_in(rows: DataFrame, asked: DataFrame, n: int, top: int, recall: float) -> DataFrame:
    """search over n vectors of one number of components."""
    sample = _stacked(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0))
    index = fit(sample, max(1, min(round(n**0.5), len(sample) // A_LIST)))
    lists = len(index.centroids)
    probes = probes_for(index, sample, top, recall)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = index.encode(_stacked(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "embedding", "list", "codes"])

    stored = materialize(rows.mapInArrow(indexed, "vec_id long, embedding array<double>, list int, codes binary"))
    # One row for each list, of which there are at most SAMPLE / A_LIST.
    counts = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}
    held = np.array([counts.get(k, 0) for k in range(lists)])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_stacked(batch.column(1)) @ index.centroids.T), axis=1, kind="stable")
                # Further lists where the first ones hold too few vectors.
                many = np.maximum(probes, (held[near].cumsum(1) <= top).sum(1) + 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row[:m].astype(np.int32) for row, m in zip(near, many, strict=True)], pa.list_(pa.int32()))], names=["query_id", "query", "lists"])

    probed = asked.mapInArrow(probing, "query_id long, query array<double>, lists array<int>")
    blocks = F.element_at(F.array(*(F.lit(-(-counts.get(k, 1) // BLOCK)) for k in range(lists))), F.col("list") + 1)
    kept = stored.select("list", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "codes")
    sent = probed.select("query_id", "query", F.explode("lists").alias("list"))
    sent = sent.select("list", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.col("query").alias("vector"), F.lit(None).cast("binary").alias("codes"))
    dealt = kept.union(sent).repartition("list", "block").sortWithinPartitions("list", "block", "side")
    found = dealt.mapInArrow(_search(index, top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
