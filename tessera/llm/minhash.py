"""Document fingerprints by MinHash (operator 3).

A fingerprint holds, for each of 128 universal hash permutations, 16 mixed
bits of the least permuted hash of a text's word shingles; the share of equal
values estimates the Jaccard similarity of two texts. Signatures are computed
in numpy over whole Arrow columns, and the pairs that the query asks for are
verified on their full sets. linking.py joins the signatures' bands in Spark
and verifies what they bring together; the query tells for each document the
first one of those that it is linked with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, column_buffer, materialize, partitions
from .linking import near_components
from .shingles import in_common, minima, mix, permutations, wide_sets

PERMUTATIONS, SEED, SHINGLE = 128, 20240112, 5


class MinHash:
    values, seed = PERMUTATIONS, SEED

    def encode(self, least: np.ndarray) -> np.ndarray:
        return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)

    def likeness(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray | None = None, n_y: np.ndarray | None = None) -> np.ndarray:
        return (x == y).mean(1)


def similar_documents(docs: DataFrame, ngram: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept by the bands of documents' fingerprints and verified Jaccard; see linking.near_components."""
    return near_components(docs, MinHash(), ngram, percent)


def signatures(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts x PERMUTATIONS values of 16 bits, and the texts' sets of shingles."""
    a, b = permutations(PERMUTATIONS, SEED)
    sets = wide_sets(*column_buffer(column), size)
    bounds = np.concatenate(([0], np.cumsum([x.shape[1] for x in sets], dtype=np.int64)))
    return MinHash().encode(minima(np.concatenate([*(x[0] for x in sets), np.zeros(0, np.uint64)]), bounds, a, b)), sets


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two wide sets; that of two empty ones is 1."""
    both = in_common(x, y)
    every = x.shape[1] + y.shape[1] - both
    return both / every if every else 1.0


def edited(text: str, following: str) -> str:
    """text, its last half replaced by as many first code points of the following one (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double, similar_id long"


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (the last column) one by one as zstandard, before they are shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in by_bytes(batches, 5):
        rows = [None if t is None else pack.compress(t.encode()) for t in batch.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows, pa.binary())], names=["range", "sentinel", "doc_id", "similar", "tie", "text"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, then documents before the sentinel that follows the bucket's last; rows with similar come right
    before the documents that they tell of."""
    unpack, told = zstandard.ZstdDecompressor(), (None, None)

    def made(ids: list, texts: list[str], sets: list, at: list[int], to: list[int], values: np.ndarray, near: dict) -> pa.RecordBatch:
        changed = [edited(texts[i], texts[j]) for i, j in zip(at, to, strict=True)]
        other, others = signatures(pa.array(changed, pa.string()))
        own, after = values[at], values[to]
        hexed = lambda rows: pa.array([r.astype("<u2").tobytes().hex() for r in rows], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                hexed(own),
                hexed(other),
                pa.array(MinHash().likeness(own, other)),
                pa.array(MinHash().likeness(own, after)),
                pa.array([jaccard(sets[i], o) for i, o in zip(at, others, strict=True)], pa.float64()),
                pa.array([jaccard(sets[i], sets[j]) for i, j in zip(at, to, strict=True)], pa.float64()),
                pa.array([near.get(ids[i], ids[i]) for i in at], pa.int64()),
            ],
            names=[f.split()[0] for f in SCHEMA.split(", ")],
        )

    held = None  # the row that still lacks its next one: bucket, doc_id, text, signature, set, and what it is similar to
    for batch in by_bytes(batches, 5, 1 << 20):
        similar = batch.column(3).to_pylist()
        near = dict([told]) | {i: s for i, s in zip(batch.column(2).to_pylist(), similar, strict=True) if s is not None}
        told = next(reversed(near.items()))
        batch = batch.filter(pa.array([s is None for s in similar], pa.bool_()))
        buckets, sentinel, ids = (batch.column(k).to_pylist() for k in range(3))
        texts = ["" if t is None else unpack.decompress(t).decode() for t in batch.column(5).to_pylist()]
        values, sets = signatures(pa.array(texts, pa.string()))
        before = held[5] if held else (None, None)
        if held:
            buckets, sentinel, ids, texts = [held[0], *buckets], [False, *sentinel], [held[1], *ids], [held[2], *texts]
            values, sets = np.vstack([held[3][None], values]), [held[4], *sets]
        held = None
        at, to = [], []
        for i, bucket in enumerate(buckets):
            if sentinel[i]:
                continue
            if bucket is None:
                at, to = [*at, i], [*to, i]
            elif i + 1 < len(buckets):
                if buckets[i + 1] == bucket:
                    at.append(i)
                    to.append(i + 1)
            else:
                held = (bucket, ids[i], texts[i], values[i], sets[i], (ids[i], near.get(ids[i], before[1] if ids[i] == before[0] else ids[i])))
        if at:
            yield made(ids, texts, sets, at, to, values, near | dict([before]))


def fingerprints(docs: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts and likeness to both.

    similar (doc_id, component_id, each doc_id once): similar_id is the
    component, and a document's own id if it isn't there.

    A document's next one is that of the next greater doc_id, and the first
    one after the last; rows that share a doc_id follow each other in the
    order of hashes of their texts. Null texts are empty, and empty texts have the
    fingerprint of the empty set. near_ columns are the share of equal values
    of two fingerprints, jaccard_ columns the likeness of the full sets that
    they estimate. Rows without a doc_id have no place in the
    order: each is its own next document, similar to none. Other columns are ignored; an empty
    table gives an empty result.

    Documents are dealt into ranges of doc_id; each range also gets a copy of
    the first document of the range after it, so one shuffle brings together
    all that are next to each other.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(spark)
    cuts = sorted(set(texts.approxQuantile("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 1 / (16 * n)))) or [0.0]
    ranges = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="range", handleInvalid="keep")
    in_range = lambda rows: ranges.transform(rows.withColumn("place", F.col("doc_id").cast("double"))).withColumn("range", F.when(F.col("doc_id").isNotNull(), F.col("range").cast("int")))
    placed = in_range(texts)
    # One row for each range, of which there are at most 4 * n.
    firsts = sorted((r["range"], r["least"]) for r in placed.where("doc_id is not null").groupBy("range").agg(F.min("doc_id").alias("least")).collect())
    after = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    sentinels = spark.createDataFrame(after, "range int, doc_id long")
    follow = texts.join(F.broadcast(sentinels), "doc_id")
    row = lambda rows, sentinel, similar, text: rows.select("range", F.lit(sentinel).alias("sentinel"), "doc_id", similar.cast("long").alias("similar"), F.xxhash64(text).alias("tie"), text.alias("text"))
    none = F.lit(None)
    rows = row(placed, False, none, F.col("text")).union(row(follow, True, none, F.col("text")))
    salted = F.coalesce("range", -1 - F.pmod(F.col("tie"), F.lit(n)).cast("int"))
    rows = rows.mapInArrow(_compressed, "range int, sentinel boolean, doc_id long, similar long, tie long, text binary")
    if similar is not None:
        rows = rows.union(row(in_range(similar.where("doc_id is not null")), False, F.col("component_id"), none.cast("string")).withColumn("text", none.cast("binary")))
    dealt = rows.repartition(n, salted).sortWithinPartitions("range", "sentinel", "doc_id", F.col("similar").asc_nulls_last(), "tie")
    return dealt.mapInArrow(_fingerprints, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs, materialize(similar_documents(docs).where("not kept").select("doc_id", "component_id").distinct()))
