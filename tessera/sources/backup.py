"""Backups: active records as JSON snapshots, and their import."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import snapshots
from ..schemas import SNAPSHOT
from .shared import file_system, write_small

#: Tag of the format.
FORMAT = "records-1"


class BackupError(ValueError):
    """A backup that can't be imported."""


def snapshot_rows(units: DataFrame, keywords: DataFrame, relations: DataFrame) -> DataFrame:
    """Snapshots of the active records."""
    return snapshots(units.where("status = 'active'"), keywords, relations)


#: The files before and after the records', by name: read in the order of names, all files are one JSON document.
HEAD, TAIL, END = "0-head.json", "zz-tail.json", "]}"


def write(units: DataFrame, keywords: DataFrame, relations: DataFrame, path: str, profile: str) -> int:
    """Active records as one JSON document {format, profile, count, memories} in a folder of files; how many.

    Records are a line each, range-sorted by updated_at and uuid, so many
    tasks write them in one order; the files one after the other are the
    document. It is written beside its place and moved there when it is
    whole; nobody else may read its files. A folder that is there already is
    an error.
    """
    spark = units.sparkSession
    state = F.to_json(F.struct("memory", "keywords", "relations"), {"ignoreNullFields": "false"})
    rows = snapshot_rows(units, keywords, relations).select("updated_at", "uuid", state.alias("state"))
    place, fs = file_system(spark, path)
    if fs.exists(place):
        raise BackupError(f"{path} is there already")
    draft = f"{path.rstrip('/')}.draft-{uuid4().hex}"
    seen = Observation()
    ordered = rows.repartitionByRange("updated_at", "uuid").sortWithinPartitions("updated_at", "uuid")
    # Each record's line begins with the comma that parts it from the one before; the first record is in the head, without one.
    first = rows.orderBy("updated_at", "uuid").limit(1).collect()
    rest = ordered.where(F.col("uuid") != first[0]["uuid"]) if first else ordered
    rest.observe(seen, F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(","), "state")).write.text(draft)
    n = seen.get["n"] + len(first)
    known = json.dumps({"format": FORMAT, "profile": profile, "count": n})
    write_small(spark, f"{draft}/{HEAD}", "\n".join([known[:-1] + ', "memories": [', *(r["state"] for r in first), ""]))
    write_small(spark, f"{draft}/{TAIL}", END + "\n")
    _private(spark, draft)
    fs.rename(file_system(spark, draft)[0], place)
    return n


def _private(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    mode = lambda octal: jvm.org.apache.hadoop.fs.permission.FsPermission(octal)
    place, fs = file_system(spark, folder)
    for status in fs.listStatus(place):
        fs.setPermission(status.getPath(), mode("600"))
    fs.setPermission(place, mode("700"))


def parse(lines: DataFrame) -> DataFrame:
    """Snapshots of lines (value: a state's JSON), with valid, false where a record can't be imported."""
    state = F.from_json("value", SNAPSHOT)
    rows = lines.select(state.alias("s"))
    good = (F.col("s.memory.status") == "active") & F.col("s.keywords").isNotNull() & F.col("s.relations").isNotNull()
    return rows.select("s.*", F.coalesce(good, F.lit(False)).alias("valid"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of a backup, read in parts; the document must be whole, and all of it importable."""
    lines = spark.read.text(path).where("value <> ''")
    record = F.col("value").startswith(',{"memory"') | F.col("value").startswith('{"memory"')
    told = lines.where(~record).limit(3).collect()
    heads = [_head(r["value"]) for r in told if r["value"] != END]
    if len(told) != 2 or len(heads) != 1 or heads[0] is None:
        raise BackupError("not one whole document")
    if heads[0].get("format") != FORMAT:
        raise BackupError("another format")
    rows = parse(lines.where(record).select(F.ltrim("value", F.lit(",")).alias("value")))
    found = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("bad")).first()
    if found["n"] != heads[0].get("count"):
        raise BackupError("records are missing")
    if found["bad"]:
        raise BackupError("a record isn't active or lacks its lists")
    return rows


def _head(line: str) -> dict | None:
    try:
        return json.loads(line + END)
    except ValueError:
        return None


def imported_units(rows: DataFrame) -> DataFrame:
    """Records with their ids and revisions."""
    return rows.where("valid").select("memory.*")


def imported_keywords(rows: DataFrame) -> DataFrame:
    """Their keywords; relations are read but not restored."""
    return rows.where("valid").select(F.col("memory.uuid").alias("memory_uuid"), F.inline("keywords"))
