"""Projections that follow from the base tables: the search index and embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import padded, trigrams

TEXTS = ("title_text", "summary_text", "keywords_text", "content_text", "recall_when_text")


def build_search_index(units: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row for each record: its fields as texts, keywords joined in order, and all of them as one."""
    k = keywords.groupBy(F.col("memory_uuid").alias("uuid")).agg(F.array_join(F.array_sort(F.collect_list("keyword_norm")), " ").alias("keywords_text"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = units.join(k, "uuid", "left").select(
        F.col("uuid").alias("memory_uuid"), "status", F.col("title_norm").alias("title_text"), empty("summary").alias("summary_text"), empty("keywords_text").alias("keywords_text"),
        F.col("content").alias("content_text"), empty("recall_when").alias("recall_when_text"),
    )
    return rows.withColumn("all_text", F.concat_ws(" ", *TEXTS))


def with_trigrams(index: DataFrame) -> DataFrame:
    """The index with the trigrams of each text, made once and not for each query."""
    return index.select("*", *(trigrams(F.col(c)).alias(f"{c}_trigrams") for c in TEXTS))


#: Characters, and records, of which a task makes the postings at a time.
CHARACTERS, RECORDS = 2_000_000, 2_000


def gram_postings(index: DataFrame) -> DataFrame:
    """gram, field, memory_uuid, size: which trigrams a record's fields have, and how many in all.

    The inverted side of the index: stored once, sorted by gram, a query reads the postings of its own grams only.
    Tasks make them for many records at once (see trigrams) and give them sorted for as many, so that a sort of all
    only has to merge.
    """
    rows = index.where("status <> 'trashed'").select("memory_uuid", *(padded(F.col(c)).alias(c.removesuffix("_text")) for c in TEXTS))
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("field", T.StringType()), T.StructField("memory_uuid", index.schema["memory_uuid"].dataType), T.StructField("size", T.IntegerType())])
    return rows.mapInArrow(_postings, schema)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = sum(_lengths(batch.column(k)) for k in range(1, batch.num_columns))
        part = (np.cumsum(n) // CHARACTERS) * batch.num_rows + np.arange(batch.num_rows) // RECORDS
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                yield from _sorted_postings(batch.slice(a, b - a))


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")


def _sorted_postings(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The postings of some records in the order of gram, field, size: windows of three characters that lie in one padded word.

    Characters are numbered in their order, with a space and a question mark among them.
    """
    names, records = sorted(rows.schema.names[1:]), rows.num_rows
    texts = [np.frombuffer("".join(t for t in rows.column(f).to_pylist() if t).encode("utf-32-le"), "uint32") for f in names]
    known = np.zeros(0x110000, "int64")
    for t in [*texts, np.array([ord(" "), ord("?")])]:
        known[t] = 1
    letters = np.flatnonzero(known)
    known[letters] = np.arange(len(letters))
    space, mark, many = known[ord(" ")], known[ord("?")], len(letters)
    found = []
    for k, (field, text) in enumerate(zip(names, texts, strict=True)):
        record = np.repeat(np.arange(records), _lengths(rows.column(field)))[:-2]
        c = known[text]
        x, y, z = c[:-2], c[1:-1], c[2:]
        whole = (y != space) | ((x == space) & (z != space))
        key = ((x * many + y) * many + z)[whole] * records + record[whole]
        # The JVM also looks for windows at the second half of a character beyond the 16-bit ones, a question mark there.
        half = (text[:-2] > 0xFFFF) & (y != space)
        key = np.sort(np.concatenate([key, ((mark * many + y) * many + z)[half] * records + record[half]]))
        gram, own = np.divmod(key[np.diff(key, prepend=-1) != 0], records)
        found.append((gram, np.full(len(gram), k), np.bincount(own, minlength=records)[own], own))
    gram, field, size, own = (np.concatenate(x) for x in zip(*found, strict=True))
    grams, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(((gram * len(names) + field) << 31) + size, kind="stable")
    spelt = ["".join(chr(letters[k]) for k in (g // many // many, g // many % many, g % many)) for g in grams.tolist()]
    columns = [pa.array(spelt, pa.string()).take(pa.array(gram[order])), pa.array(names, pa.string()).take(pa.array(field[order])), rows.column(0).take(pa.array(own[order])), pa.array(size[order].astype("int32"))]
    made = pa.RecordBatch.from_arrays(columns, names=["gram", "field", "memory_uuid", "size"])
    for k in range(0, made.num_rows, 1 << 16):
        yield made.slice(k, 1 << 16)


def gram_counts(postings: DataFrame) -> DataFrame:
    """gram, n: in how many fields of records each gram is. Made of stored postings it takes no pass over the texts."""
    return postings.groupBy("gram").agg(F.count("*").alias("n"))


def refresh_index(index: DataFrame, units: DataFrame, keywords: DataFrame, touched: DataFrame) -> DataFrame:
    """The index with the rows of touched (uuid) made anew, and those of records that are gone left out."""
    ids = touched.select(F.col("uuid").alias("memory_uuid")).distinct()
    fresh = build_search_index(units.join(touched.select("uuid").distinct(), "uuid", "left_semi"), keywords.join(ids, "memory_uuid", "left_semi"))
    return index.join(ids, "memory_uuid", "left_anti").unionByName(fresh)


def upsert_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh replaces what is stored for the same record."""
    return stored.join(fresh.select("memory_uuid"), "memory_uuid", "left_anti").unionByName(fresh)


def current_embeddings(fresh: DataFrame, states: DataFrame) -> DataFrame:
    """fresh (memory_uuid, state_hash, ...) with conflict, true where the record's state (uuid, state_hash) is another
    by now; embeddings of records that are gone are left out."""
    now = states.select(F.col("uuid").alias("memory_uuid"), F.col("state_hash").alias("now_hash"))
    return fresh.join(now, "memory_uuid").withColumn("conflict", F.col("state_hash") != F.col("now_hash")).drop("now_hash")


def dimension_violations(embeddings: DataFrame, dimension: int) -> DataFrame:
    size = F.size("embedding").cast("long")
    return embeddings.where((size != dimension) | (F.col("embedding_dimension") != dimension) | (F.col("embedding_model") == "")).select("memory_uuid", size.alias("size"), "embedding_dimension")
