"""Small helpers that several training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, release, scratch

__all__ = ["ascii_lower", "by_bytes", "column_buffer", "materialize", "might_be_in", "partitions", "release", "scratch", "small_batches"]

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Bounds the bytes of Arrow batches, so that Python workers fit into small executors.

    A setting of the whole session, so for programs only; operators take
    batches of any size and leave it alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def ascii_lower(column):
    """A-Z to a-z, all else as it is."""
    return F.translate(column, UPPER, LOWER)


def column_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def by_bytes(batches, column: int, most: int = 2 << 20):
    """The same rows in batches whose texts have most bytes in all, or one row; keeps empty batches out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: Places of one row of a bitmap, and the least and most places of all rows.
BITMAP_ROW, BITMAP_LEAST, BITMAP_MOST = 1 << 15, 1 << 18, 1 << 30


def might_be_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows with a boolean column __maybe, false only where the id in column isn't in ids.

    A bitmap of hashed ids, 16 places for each id and at most BITMAP_MOST
    (128 MB), is broadcast, so that most rows without a partner need no
    shuffle. Those that may have one are left to an exact join.
    """
    name = ids.columns[0]
    places = BITMAP_LEAST
    while places < 16 * ids.count() and places < BITMAP_MOST:
        places *= 2
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(places))
    row = lambda c: F.floor(F.col(c) / BITMAP_ROW).cast("int")
    marked = ids.select(at(name).alias("__at")).groupBy(row("__at").alias("__row")).agg(F.bitmap_construct_agg(F.col("__at") % BITMAP_ROW).alias("__bits"))
    placed = rows.withColumn("__at", at(column)).withColumn("__row", row("__at"))
    found = placed.join(F.broadcast(marked), "__row", "left")  # places / 8 bytes
    bit = F.col("__at") % BITMAP_ROW
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return found.select(*rows.columns, hit.alias("__maybe"))
