"""Embedding and rerank providers: what they send back, and embeddings of many records at once.

Calls themselves are injected (a function from texts to vectors); nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks
from ..functions.vectors import mean_pool
from .shared import materialize


class ProviderError(ValueError):
    """A response that can't be used."""


def embedding(response, dimension: int | None = None) -> list[float]:
    """The first vector of {"data": [{"embedding": [...]}]} or of [{"embedding": [[...]]}]."""
    items = response.get("data") if isinstance(response, dict) else response
    if not items:
        raise ProviderError("no embedding")
    vector = items[0].get("embedding")
    if vector and isinstance(vector[0], list):
        vector = vector[0]
    if not vector or dimension is not None and len(vector) != dimension:
        raise ProviderError("embedding of another dimension")
    return [float(x) for x in vector]


def ranks(response, n: int) -> list[tuple[int, float]]:
    """(index, score) in the provider's order; an index beyond the documents is an error."""
    items = response.get("results", response.get("data", [])) if isinstance(response, dict) else response
    out = []
    for item in items:
        at, score = item["index"], item.get("relevance_score", item.get("score"))
        if not 0 <= at < n or score is None:
            raise ProviderError("rank of no document")
        out.append((at, float(score)))
    return out


VECTORS = "embedding array<double>, error string"


def embed(inputs: DataFrame, call: Callable[[Sequence[str]], Sequence[Sequence[float]]], model: str, dimension: int | None = None) -> DataFrame:
    """inputs (memory_uuid, text): embedding, the pooled vector of a text's chunks, or null and error, with model and dimension.

    Calls run in the tasks, a batch at a time. If one fails its texts are
    sent one by one, so that a text only fails by itself; a vector of another
    dimension is an error as well. Null texts have no row.
    """
    parts = inputs.select("memory_uuid", F.posexplode(chunks(F.col("text"))).alias("place", "chunk"))
    key = inputs.schema["memory_uuid"].dataType.simpleString()

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return [float(x) for x in call([text])[0]], None
        except Exception as e:  # whatever a provider does wrong is that text's error
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["chunk"].tolist()
            try:
                found = [([float(x) for x in v], None) for v in call(texts)]
                if len(found) != len(texts):
                    raise ProviderError("another number of vectors than of texts")
            except Exception:
                found = [one(t) for t in texts]
            yield pd.DataFrame({"memory_uuid": batch["memory_uuid"], "embedding": [v for v, _ in found], "error": [e for _, e in found]})

    made = materialize(parts.mapInPandas(run, f"memory_uuid {key}, {VECTORS}"))  # a provider is asked once
    wrong = made.groupBy("memory_uuid").agg(F.min("error").alias("error"), F.count_distinct(F.size("embedding")).alias("sizes"))
    wrong = wrong.select("memory_uuid", F.coalesce("error", F.when(F.col("sizes") > 1, "vectors of unlike dimensions")).alias("error"))
    good = made.join(wrong.where("error is null").select("memory_uuid"), "memory_uuid", "left_semi").drop("error")
    size = F.size("embedding")
    unlike = F.when(F.col("embedding").isNull() & F.col("error").isNull(), "no vector")
    unlike = unlike.when(size != dimension, F.concat(F.lit("embedding of dimension "), size.cast("string"))) if dimension is not None else unlike
    rows = wrong.join(mean_pool(good), "memory_uuid", "left").withColumn("error", F.coalesce("error", unlike))
    vector = F.when(F.col("error").isNull(), F.col("embedding").cast("array<float>"))
    return rows.select("memory_uuid", vector.alias("embedding"), F.lit(model).alias("embedding_model"), F.size(vector).alias("embedding_dimension"), "error")
