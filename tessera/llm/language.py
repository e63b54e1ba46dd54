"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 11).

A text is its letters, lower-cased, with one mark for whatever parts words;
its features are all runs of one to three of these, hashed into buckets.
Languages count their buckets over all documents that they may learn from.
Log-probabilities are whole multiples of 2^-20, so a score is an exact sum
however a text's features are dealt with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, column_buffer, materialize, release

#: Longest n-grams, buckets as a power of two, what is added to each count, and the fixed-point unit of logarithms.
LONGEST, BITS, SMOOTH, UNIT = 3, 16, 0.5, 1 << 20
#: Languages of one broadcast matrix: 4 bytes a language and bucket, so 32 MB at most. More languages take more passes.
BLOCK = 128
#: Features that are worked on at a time, slices that a language's counts are shuffled in, and slices a task sums at a time.
AT_ONCE, SLICES, SUMS = 1 << 18, 16, 2000
#: Odd multipliers of the hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of texts one after the other, with 0 before and between and after words, and the texts' bounds (one 0 at least each)."""
    data, offsets = column_buffer(column)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = before[offsets]
    n = len(at) - 1
    out = np.zeros(len(codes) + 2 * n, np.uint32)
    out[np.arange(len(codes)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))] = _letters()[codes]
    first = at[:-1] + 2 * np.arange(n)
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    keep[first] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[np.append(first, len(out))]


def buckets(codes: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """For the places lo to hi the bucket of the n-gram that begins there, by length; 1 << BITS where there is none."""
    none = 1 << BITS
    out = []
    key = np.zeros(hi - lo, np.uint64)
    for n in range(1, LONGEST + 1):
        own = codes[lo + n - 1 : hi + n - 1].astype(np.uint64)
        key[: len(own)] += own * ODD[n - 1]
        found = (((key + np.uint64(n)) * ODD[3]) >> np.uint64(64 - BITS)).astype(np.int32)
        if n == 1:
            found[own == 0] = none
        for k in range(1, n):  # those that reach over a text's end
            last = bounds[1:] - k
            last = last[(last >= np.maximum(bounds[:-1], lo)) & (last < hi)]
            found[last - lo] = none
        out.append(found)
    return out


def counted(column: pa.Array, group: np.ndarray, groups: int) -> np.ndarray:
    """How often the texts of each group have each bucket."""
    codes, bounds = folded(column)
    total = np.zeros(groups * ((1 << BITS) + 1), np.int64)
    width = (1 << BITS) + 1
    each = np.repeat(group.astype(np.int32), np.diff(bounds))
    for lo in range(0, len(codes), AT_ONCE):
        hi = min(lo + AT_ONCE, len(codes))
        for found in buckets(codes, bounds, lo, hi):
            total += np.bincount(each[lo:hi].astype(np.int64) * width + found, minlength=len(total))
    return total.reshape(groups, width)[:, :-1]


@dataclass
class Languages:
    """Some languages: their names, (1 << BITS) + 1 rows of log-probabilities in UNITs (the last is 0), and their priors."""

    names: list[str]
    logs: np.ndarray
    priors: np.ndarray

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text and language in UNITs, and whether the text has a letter."""
        codes, bounds = folded(column)
        total = np.tile(self.priors, (len(bounds) - 1, 1))
        step = max(1, AT_ONCE // max(1, len(self.names) // 16))
        for lo in range(0, len(codes), step):
            hi = min(lo + step, len(codes))
            own = sum(self.logs[found].astype(np.int64) for found in buckets(codes, bounds, lo, hi))
            first, last = np.searchsorted(bounds, [lo, hi - 1], "right") - 1
            total[first : last + 1] += np.add.reduceat(own, np.maximum(bounds[first : last + 1], lo) - lo, axis=0)
        lettered = np.concatenate(([0], np.cumsum(codes != 0)))
        return total, lettered[bounds[1:]] > lettered[bounds[:-1]]


_COUNTS = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("salt", pa.int32()), ("docs", pa.int64()), ("counts", pa.binary())])
COUNTS = "lang string, slice int, salt int, docs long, counts binary"


def _sums(held: dict[tuple, list]) -> pa.RecordBatch:
    rows = [(*key, docs, counts.tobytes()) for key, (docs, counts) in held.items()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(_COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, salt) to partial counts by language and slice."""
    held: dict[tuple, list] = {}
    for batch in by_bytes(batches, 1):
        names, group = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(object).astype(str), return_inverse=True)
        salt = batch.column(2)[0].as_py()
        for lo in range(0, len(names), 16):
            some = (group >= lo) & (group < lo + 16)
            texts = batch.column(1).filter(pa.array(some))
            own = counted(texts, group[some] - lo, min(16, len(names) - lo))
            docs = np.bincount(group[some] - lo, minlength=len(own))
            for k, counts in enumerate(own):
                for s, part in enumerate(counts.reshape(SLICES, -1)):
                    into = held.setdefault((str(names[lo + k]), s, salt), [0, np.zeros(part.shape, np.int64)])
                    into[0] += int(docs[k]) if s == 0 else 0
                    into[1] += part
            if len(held) >= SUMS:
                yield _sums(held)
                held = {}
    yield _sums(held)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts to their sums, a salt for all."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for lang, s, salt, docs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            into = held.setdefault((lang, s, salt), [0, np.zeros(len(counts) // 8, np.int64)])
            into[0] += docs
            into[1] += np.frombuffer(counts, np.int64)
            if len(held) >= SUMS:
                yield _sums(held)
                held = {}
    yield _sums(held)


def learn(docs: DataFrame) -> list[Languages]:
    """The languages of docs (lang, text): all rows with a lang count, a null text as an empty one. In blocks of BLOCK languages.

    Each task counts on its own; the counts are added in two steps, the first
    of which deals a language's counts out, so that a hot one isn't one task's.
    The driver gets the sums, half a megabyte a language, a block at a time.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(32))
    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), salt.alias("salt"))
    dealt = rows.mapInArrow(_count, COUNTS).repartition("lang", "slice", "salt").mapInArrow(_add, COUNTS)
    dealt = dealt.withColumn("salt", F.lit(0)).repartition("lang", "slice").mapInArrow(_add, COUNTS)
    sums = materialize(dealt)
    docs_of = {r["lang"]: r["docs"] for r in sums.groupBy("lang").agg(F.sum("docs").alias("docs")).collect()}  # a row a language
    names, every = sorted(docs_of), sum(docs_of.values())
    out = []
    for lo in range(0, len(names), BLOCK):
        own = names[lo : lo + BLOCK]
        counts = np.zeros((len(own), SLICES, (1 << BITS) // SLICES), np.int64)
        for r in sums.where(F.col("lang").isin(own)).select("lang", "slice", "counts").toLocalIterator():
            counts[own.index(r["lang"]), r["slice"]] += np.frombuffer(r["counts"], np.int64)
        counts = counts.reshape(len(own), -1)
        logs = np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * (1 << BITS)))
        logs = np.vstack([np.round(logs.T * UNIT), np.zeros((1, len(own)))]).astype(np.int32)
        priors = np.round(np.log([docs_of[x] / every for x in own]) * UNIT).astype(np.int64)
        out.append(Languages(own, logs, priors))
    release(sums)
    return out


NAMES = ("lang_pred", "score")


def identify(docs: DataFrame, model: list[Languages], names: tuple[str, str] = NAMES) -> DataFrame:
    """docs with lang_pred, the likeliest language of the whole text, and score, its probability among all.

    und and 0 for a null text, one without a letter, and if no language is
    known. Ties go to the language that comes first. Rows are judged one by
    one, also repeated ones; an empty table gives an empty result. All
    columns come back; theirs of the same names are replaced.
    """
    own = [f for f in docs.schema.fields if f.name not in names]
    place = [f.name for f in own].index("text")
    held = [T.StructField("__lang", T.StringType()), T.StructField("__best", T.LongType()), T.StructField("__all", T.DoubleType())]
    rows = docs.select(*(f.name for f in own), *(F.lit(None).cast(f.dataType).alias(f.name) for f in held))

    def judge(languages):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = languages.value
            for batch in by_bytes(batches, place):
                scores, lettered = known.scores(batch.column(place))
                at = scores.argmax(1)
                best = scores[np.arange(len(at)), at]
                whole = best / UNIT + np.log(np.exp((scores - best[:, None]) / UNIT).sum(1))
                lang, was, whole_was = (batch.column(len(own) + k) for k in range(3))
                old = np.array(was.fill_null(np.iinfo(np.int64).min))
                lang = np.where(best > old, np.array(known.names, object)[at], np.array(lang.to_pylist(), object))
                more = [pa.array(np.where(lettered, lang, None), pa.string()), pa.array(np.maximum(best, old)), pa.array(np.logaddexp(whole, np.array(whole_was.fill_null(-np.inf))))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *more], names=[f.name for f in [*own, *held]])

        return run

    for languages in model:
        rows = rows.mapInArrow(judge(docs.sparkSession.sparkContext.broadcast(languages)), T.StructType([*own, *held]))
    likely = F.exp(F.col("__best") / UNIT - F.col("__all"))
    known = F.col("__lang").isNotNull()
    return rows.select(*(f.name for f in own), F.coalesce("__lang", F.lit(UNKNOWN)).alias(names[0]), F.when(known, F.least(F.lit(1.0), likely)).otherwise(0.0).alias(names[1]))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from: crc32 of the decimal doc_id leaves 2 when divided by 4; a null one isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).drop("text")
