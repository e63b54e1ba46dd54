"""MinHash near-dedup with SetSketch registers (operator 10).

For each register a set keeps the least of exponentially distributed values
of its shingles as a truncated logarithm, so that registers of two sets
merge by maximum, and how many of them are higher, lower or equal tells the
Jaccard similarity by maximum likelihood. Bands of registers find
candidates; linking.py confirms them on the full sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import materialize, might_be_in
from .linking import near_components

#: Registers and the seed of their hash functions; base of the registers' logarithm, rate of the exponential values, highest register.
VALUES, SEED = 192, 20240109
BASE, RATE, TOP = 1.02, 20.0, 4000


class SetSketch:
    values, seed = VALUES, SEED

    def encode(self, least: np.ndarray) -> np.ndarray:
        unit = np.minimum((least.astype(np.float64) + 1.0) / 2.0**64, 1 - 2.0**-53)
        value = -np.log1p(-unit) / RATE
        return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)

    def merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sketch of the union of two sets."""
        return np.maximum(x, y)

    def likeness(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
        """With u and v the shares of both sizes, a register of x is the higher
        one with probability p(u - v J), the lower one with p(v - u J), where
        p(z) = -log_b(1 - z (b - 1) / b); the J that makes the counts likeliest.
        """
        higher, lower = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
        grid = np.linspace(0, 1, 201)[None, :]
        u = (n_x / (n_x + n_y))[:, None]
        v = 1 - u
        up, down = (-np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE) for z in (u - v * grid, v - u * grid))
        tiny = 1e-12
        score = higher * np.log(np.maximum(up, tiny)) + lower * np.log(np.maximum(down, tiny)) + (VALUES - higher - lower) * np.log(np.maximum(1 - up - down, tiny))
        return grid[0][np.where(grid <= np.minimum(u / v, v / u) + 1e-9, score, -np.inf).argmax(1)]


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept by SetSketch; see linking.near_components."""
    return near_components(docs, SetSketch(), ngram, percent)


def deduplicated(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near-dedup keeps: of each component the one with the least doc_id.

    Documents without shingles and rows without a doc_id all stay; of rows
    that repeat a kept doc_id all stay.
    """
    gone = materialize(near_duplicates(docs, ngram, percent).where("not kept").select("doc_id").distinct())
    marked = might_be_in(docs, "doc_id", gone)
    stay = marked.where("not __maybe").select(*docs.columns)
    return stay.union(marked.where("__maybe").join(gone, "doc_id", "left_anti").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked from 85 % on."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 85)
