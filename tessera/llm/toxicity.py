"""Toxicity by cumulative-link ordinal regression (operator 7).

Severity grades 0 (clean) to 3 follow P(grade > k) = s(w x - t_k) with one
weight vector w over sparse word features for all ordered thresholds t_k.
Labels only say toxic or not, so a labelled toxic text is graded by how many
different words it holds that the labelled sample ties to toxic texts: the
severity of a text is how much of that it says, not how bad each word is, and
toxic_words in the output tells the count. Copies of a labelled text count
once. The model is fitted on a bounded sample of labelled documents and then
scores every document; its output is the expected severity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, column_buffer
from .shingles import word_hashes

#: Labelled documents fitted on at most; least documents of the sample that a feature needs, and how many
#: standard deviations its count in graded texts must be off what chance gives.
SAMPLE, LEAST_DOCS, DEVIATIONS = 10_000, 3, 5.0
#: Numbers of different toxic words from which a toxic text has grade 2 and 3.
GRADE_CUTS = (3, 5)
#: Strength of the L1 penalty, steps and step size of the fit.
PENALTY, STEPS, RATE = 1e-4, 300, 0.1
#: Expected severity from which a document is rejected.
REJECT = 0.5

#: Bytes that words are made of: letters, digits and all beyond ASCII; others part words.
_WORD_BYTES = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words (A-Z as a-z, punctuation parts words) and the texts' bounds in them."""
    data, offsets = column_buffer(column)
    return word_hashes(_WORD_BYTES[data], offsets)


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different features, how often it has them, and the texts' bounds in both."""
    words, at = features(column)
    sets = [np.unique(words[at[i] : at[i + 1]], return_counts=True) for i in range(len(at) - 1)]
    keys, counts = ([s[k] for s in sets] for k in (0, 1))
    bounds = np.concatenate(([0], np.cumsum([len(k) for k in keys], dtype=np.int64)))
    return np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64), bounds


def strength(counts: np.ndarray) -> np.ndarray:
    """Value of a feature that a text has so many times."""
    return 1 + np.log(counts)


@dataclass
class Ordinal:
    """Sorted feature hashes, their weights, and the ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """w x of each text."""
        return self.told(column)[0]

    def told(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """w x of each text, and how many different words it has that raise it."""
        words, at = features(column)
        total, raising = np.zeros(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        if not len(self.keys) or not len(words):
            return total, raising
        place = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == words)
        text = np.searchsorted(at, hit, "right") - 1
        cell, counts = np.unique(text * len(self.keys) + place[hit], return_counts=True)
        np.add.at(total, cell // len(self.keys), self.weights[cell % len(self.keys)] * strength(counts))
        np.add.at(raising, cell // len(self.keys), (self.weights[cell % len(self.keys)] > 0).astype(np.int64))
        return total, raising

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))
        above = np.hstack([np.ones((len(score), 1)), above, np.zeros((len(score), 1))])
        return above[:, :-1] - above[:, 1:]

    def severity(self, score: np.ndarray) -> np.ndarray:
        p = self.grades(score)
        return p @ np.arange(p.shape[1])


def fit(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray, grades: np.ndarray, top: int) -> Ordinal:
    """Likelihood of the grades (0 to top) under an L1 penalty on the shared weights, by proximal Adam."""
    rows = np.repeat(np.arange(len(grades)), np.diff(bounds))
    names, cols, count = np.unique(keys, return_inverse=True, return_counts=True)
    hurt, total = int((grades > 0).sum()), max(1, len(grades))
    share = count / total
    chance = np.sqrt(np.maximum(hurt * share * (1 - share) * (1 - hurt / total), 1e-9))
    often = (count >= LEAST_DOCS) & (np.abs(np.bincount(cols, grades[rows] > 0, len(names)) - hurt * share) >= DEVIATIONS * chance)
    place = np.cumsum(often) - 1
    keep = often[cols]
    names, rows, cols, value = names[often], rows[keep], place[cols[keep]], strength(counts[keep])
    n, d = len(grades), len(names)
    share = np.array([np.mean(grades > k) if n else 0.0 for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    # thresholds: the first, then positive gaps as exponentials
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 0.1))))
    w = np.zeros(d)
    moment = [np.zeros(d), np.zeros(d), np.zeros(top), np.zeros(top)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    each = np.arange(n)
    for step in range(1, STEPS + 1 if n and d else 1):
        t = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        z = np.bincount(rows, w[cols] * value, n)
        above = np.hstack([np.ones((n, 1)), sigmoid(z[:, None] - t), np.zeros((n, 1))])
        slope = above * (1 - above)
        p = np.maximum(above[each, grades] - above[each, grades + 1], 1e-12)
        dz = -(slope[each, grades] - slope[each, grades + 1]) / p / n
        dt = np.zeros((n, top + 2))
        dt[each, grades] += slope[each, grades] / p / n
        dt[each, grades + 1] -= slope[each, grades + 1] / p / n
        dt = dt.sum(0)[1:-1]
        later = dt[::-1].cumsum()[::-1]
        grad_t = np.concatenate((later[:1], later[1:] * np.exp(free[1:])))
        grad_w = np.bincount(cols, dz[rows] * value, d)
        for free_, grad, m, v in ((w, grad_w, moment[0], moment[1]), (free, grad_t, moment[2], moment[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            scale = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            free_ -= scale * m / (1 - 0.9**step)
            if free_ is w:
                np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale, 50.0) * PENALTY, 0))
    t = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
    used = np.flatnonzero(w)
    return Ordinal(names[used], w[used], t)


def graded(keys: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of labelled texts: 0 if not toxic, else by their number of words that the labels tie to toxicity."""
    rows = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    _, cols = np.unique(keys, return_inverse=True)
    bad, good = np.bincount(cols, toxic[rows] == 1), np.bincount(cols, toxic[rows] == 0)
    n_bad, n_good = max(1, (toxic == 1).sum()), max(1, (toxic == 0).sum())
    tied = (bad >= LEAST_DOCS) & (np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1)) > 3)
    held = np.bincount(rows, tied[cols], len(toxic))
    return np.where(toxic == 1, 1 + sum((held >= c).astype(np.int64) for c in GRADE_CUTS), 0)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1):
        keys, counts, bounds = counted(batch.column(1))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), cut(keys), cut(counts.astype(np.int32))], names=["toxic", "features", "counts"])


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary rows one after the other, and how many each row has."""
    parts = [np.frombuffer(x.as_py(), kind) for x in column]
    return np.concatenate([*parts, np.zeros(0, kind)]), np.array([len(x) for x in parts], np.int64)


def _frequent(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features without those that fewer than LEAST_DOCS texts have."""
    order = np.sort(keys)
    often = order[LEAST_DOCS - 1 :][order[LEAST_DOCS - 1 :] == order[: len(order) - LEAST_DOCS + 1]] if len(order) >= LEAST_DOCS else order[:0]
    often = np.unique(often)
    place = np.minimum(np.searchsorted(often, keys), max(0, len(often) - 1))
    keep = often[place] == keys if len(often) else np.zeros(len(keys), bool)
    return keys[keep], counts[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most sample labelled documents, those of the least hashes of doc_id.

    Labels that are null, or whose document is missing, are left out; a null
    text has no features. Equal texts count once, as toxic if one is labelled
    so. Without labels every text scores as clean.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")  # sample rows at most
    once = texts.groupBy(F.sha2("text", 256)).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    found = once.select("toxic", "text").mapInArrow(_labelled, "toxic int, features binary, counts binary").toArrow()
    toxic = found["toxic"].to_numpy().astype(np.int64)
    (keys, lengths), (counts, _) = (_joined(found[c], kind) for c, kind in (("features", np.uint64), ("counts", np.int32)))
    del found
    bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    keys, counts, bounds = _frequent(keys, counts, bounds)
    return fit(keys, counts, bounds, graded(keys, bounds, toxic), len(GRADE_CUTS) + 1)


NAMES = ("expected_severity", "severity_grade", "toxic", "toxic_words")


def judge(docs: DataFrame, model: Ordinal, reject: float = REJECT, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with expected_severity, severity_grade (the likeliest), toxic (severity of reject or more, and words that raise it) and toxic_words (how many).

    Whole texts count. Null and empty texts have no features, and the
    severity of a text without any; repeated rows are judged one by one, an
    empty table gives an empty result. All columns come back; theirs of the
    same names are replaced. names: what the columns are called, the first
    ones if fewer are wanted.
    """
    own = [f for f in docs.schema.fields if f.name not in names]
    kept = docs.select(*(f.name for f in own))
    place = [f.name for f in own].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, place):
            score, raising = model.told(batch.column(place))
            severity, grade = model.severity(score), model.grades(score).argmax(1)
            more = [pa.array(severity), pa.array(grade.astype(np.int32)), pa.array((severity >= reject) & (score > 0)), pa.array(raising)][: len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[f.name for f in own] + list(names))

    return kept.mapInArrow(run, T.StructType([*own, *map(T.StructField, names, (T.DoubleType(), T.IntegerType(), T.BooleanType(), T.LongType()))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
