"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of intermediate tables, by application.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder of intermediate tables.

    It lies in the folder that a cluster names in spark.checkpoint.dir; only
    in local mode, where that is unset, in a temporary one. It is removed
    when Python ends, since results may be read until then.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _OWN[app] = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/tessera-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def file_system(spark: SparkSession, path: str):
    """A path and the file system that it lies in, as the driver sees them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A new file of a few lines."""
    place, fs = file_system(spark, path)
    out = fs.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's file systems, so wherever it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    try:
        place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
    except Exception as e:  # what is left over costs only room
        logging.getLogger(__name__).warning("can't remove %s: %s", path, e)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage in a way that outlives executors, and later readers
    still get column pruning. release deletes it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def release(*tables: DataFrame) -> None:
    """Deletes what materialize wrote for these tables, once nothing reads them any more."""
    for table in tables:
        _remove(table.sparkSession, table.written_to)
