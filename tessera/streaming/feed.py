"""A feed of edits as a stream: open changes and the search index follow it, and the trash of all stores is swept.

This goes beyond single edits at a time: it is the batch operators in
foreachBatch, each micro-batch committed once, as rows of what it touches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.commands import change_baseline, upsert_changes
from ..operators.index import build_search_index, gram_postings
from ..operators.review import expired
from ..sources.config import Config
from ..sources.store import Delta, Snapshot, Store


def name_of(checkpoint: str) -> str:
    """A stream is its checkpoint: epochs of another one count anew, and must not be taken for this one's."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def open_changes(store: Store, feed: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """feed (memory_uuid, order_id, action, before_state, after_state, ts): keeps one open change for each record."""
    stream = f"feed-{name_of(checkpoint)}"

    def apply(batch: DataFrame, epoch: int) -> None:
        edits = change_baseline(batch)
        times = batch.groupBy("memory_uuid").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        fresh = edits.join(times, "memory_uuid").select("memory_uuid", "action", "before_state", "after_state", "created_at", "updated_at")

        def merged(seen: Snapshot) -> dict[str, Delta]:
            now = seen.read("changes")
            return {"changes": Delta(upsert_changes(now.join(fresh.select("memory_uuid"), "memory_uuid", "left_semi"), fresh) if now is not None else fresh)}

        store.retry(merged, (stream, epoch))

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def index_refresh(store: Store, touched: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """touched (uuid): makes the index rows and postings of these records anew, where the store has them."""
    stream = f"index-{name_of(checkpoint)}"

    def apply(batch: DataFrame, epoch: int) -> None:
        ids = batch.select("uuid").distinct()
        gone = ids.withColumnRenamed("uuid", "memory_uuid")

        def merged(seen: Snapshot) -> dict[str, Delta]:
            built = build_search_index(seen.read("units").join(ids, "uuid", "left_semi"), seen.read("keywords").join(gone, "memory_uuid", "left_semi"))
            made = {"search_index": Delta(built, gone), "postings": Delta(gram_postings(built), gone)}
            return {name: change for name, change in made.items() if seen.segments(name)}

        store.retry(merged, (stream, epoch))

    return touched.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Tables that lose a record's rows with it, and the column that names the record.
OWNED = {"units": "uuid", "keywords": "memory_uuid", "embeddings": "memory_uuid", "usage": "memory_uuid", "search_index": "memory_uuid", "postings": "memory_uuid", "embedding_requests": "memory_uuid", "changes": "memory_uuid"}


def sweep(store: Store, as_of, retention_minutes: int, failed: Callable[[Exception], None] = lambda e: None) -> int:
    """Takes expired records out of the trash and their rows out of all tables; how many. A store that can't be read is left as it is."""
    n = 0

    def merged(seen: Snapshot) -> dict[str, Delta | DataFrame]:
        nonlocal n
        gone = expired(seen.read("changes"), seen.read("units"), as_of, retention_minutes).select("uuid").distinct()
        n = gone.count()
        if not n:
            return {}
        changes: dict[str, Delta | DataFrame] = {name: Delta(gone=gone.withColumnRenamed("uuid", column)) for name, column in OWNED.items() if seen.segments(name)}
        if (edges := seen.read("relations")) is not None:
            at = lambda end: edges.join(gone.withColumnRenamed("uuid", end), end, "left_semi").select("uuid")
            changes["relations"] = Delta(gone=at("from_memory_uuid").union(at("to_memory_uuid")).distinct())
        meta = seen.read("graph_meta")
        built_at = meta.agg(F.max("revision").alias("r")).first()["r"] if meta is not None and "revision" in meta.columns else None
        changes["graph_meta"] = store.spark.range(1).select(F.lit(True).alias("dirty"), F.lit(as_of).cast("timestamp").alias("updated_at"), F.lit(built_at).cast("long").alias("revision"))
        return changes

    try:
        if store.snapshot().revision == 0:
            raise ValueError(f"no store in {store.root}")
        store.retry(merged)
    except Exception as e:
        failed(e)
        return 0
    return n


def sweep_profiles(spark: SparkSession, config: Config, as_of, failed: Callable[[str, Exception], None] = lambda name, e: None, at_once: int = 8) -> dict[str, int]:
    """Sweeps each configured store, some at a time; how many records went from each. One that fails is told and doesn't keep the others."""
    with ThreadPoolExecutor(at_once) as pool:
        counts = pool.map(lambda p: sweep(Store(spark, p[1]), as_of, config.retention_minutes, lambda e: failed(p[0], e)), config.profiles)
        return dict(zip((name for name, _ in config.profiles), counts, strict=True))


def sweeps(spark: SparkSession, load: Callable[[], Config], clock: Callable[[], datetime], checkpoint: str, failed: Callable[[str, Exception], None] = lambda name, e: None, every: str | None = None) -> StreamingQuery:
    """Sweeps all stores now, and then each time that the configured minutes (one at least) have passed.

    The settings are read anew each time; if that fails, that sweep is left
    out. A source that ticks drives it, so it runs, is watched and is stopped like any other stream.
    """

    def once() -> None:
        try:
            config = load()
        except Exception as e:
            failed("", e)
            return
        sweep_profiles(spark, config, F.lit(clock()), failed)

    once()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, epoch: once()).option("checkpointLocation", checkpoint).trigger(processingTime=every or f"{max(1, load().sweep_minutes)} minutes").start()
