"""Column expressions on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def mean_pool(parts: DataFrame, id_column: str = "memory_uuid", vector: str = "embedding") -> DataFrame:
    """One vector for each id: its only one as it is, else the sum of all over that sum's length; null if that is zero."""
    count = parts.groupBy(id_column).agg(F.count("*").alias("n"), F.first(vector).alias("only"))
    items = parts.select(id_column, F.posexplode(vector).alias("place", "value"))
    sums = items.groupBy(id_column, "place").agg(F.sum(F.col("value").cast("double")).alias("value"))
    whole = sums.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))
    total = F.transform("cells", lambda c: c["value"])
    length = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x))
    pooled = whole.withColumn("total", total).withColumn("length", length)
    pooled = pooled.withColumn("pooled", F.when(F.col("length") > 0, F.transform("total", lambda x: x / F.col("length"))))
    return count.join(pooled, id_column).select(id_column, F.when(F.col("n") == 1, F.col("only").cast("array<double>")).otherwise(F.col("pooled")).alias(vector))
