"""Embeddings of approved records, made after the approval: a queue of requests in the store, and a job that works it off."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import embedding_input
from ..operators import index, listing
from ..schemas import TABLES
from ..sources import providers
from ..sources.shared import materialize, release
from ..sources.store import Delta, Snapshot, Store

#: Times that a record's embedding is tried.
ATTEMPTS = 3

Call = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def _table(seen: Snapshot, name: str) -> DataFrame:
    rows = seen.read(name)
    return rows if rows is not None else seen.spark.createDataFrame([], TABLES[name])


def _states(seen: Snapshot, ids: DataFrame) -> DataFrame:
    """memory_uuid, state_hash, text: the states of some records (memory_uuid), and what of them is embedded."""
    own = lambda name, column: _table(seen, name).join(ids.withColumnRenamed("memory_uuid", column), column, "left_semi")
    touching = own("relations", "from_memory_uuid").union(own("relations", "to_memory_uuid").select(*_table(seen, "relations").columns)).select(*_table(seen, "relations").columns).distinct()
    units = own("units", "uuid")
    states = listing.snapshots(units, own("keywords", "memory_uuid"), touching)
    m = lambda f: F.col(f"memory.{f}")
    text = embedding_input(m("title_norm"), m("summary"), m("content"), F.transform("keywords", lambda k: k["keyword_norm"]))
    return states.select(F.col("uuid").alias("memory_uuid"), F.sha2(listing.state_json(), 256).alias("state_hash"), text.alias("text"))


def refresh(store: Store, call: Call, model: str, dimension: int | None = None, attempts: int = ATTEMPTS) -> int:
    """Works off the requests that were tried less than attempts times; how many embeddings it made.

    The provider is called in the tasks, without the store being held up. An
    embedding is kept only if its record's state is still the one that was
    embedded; else the request stays for the next time. A failure is counted
    and told in the request, each record's by itself. Requests of records
    that are gone, or have no text, go.
    """
    seen = store.snapshot()
    asked = _table(seen, "embedding_requests").where(F.col("attempts") < attempts)
    if asked.isEmpty():
        return 0
    ids = materialize(asked.select("memory_uuid"))
    inputs = materialize(_states(seen, ids))
    made = materialize(providers.embed(inputs.select("memory_uuid", "text"), call, model, dimension))
    made_of = materialize(ids.join(inputs.select("memory_uuid", "state_hash"), "memory_uuid", "left").join(made, "memory_uuid", "left"))
    done = 0

    def merged(now: Snapshot) -> dict[str, Delta]:
        nonlocal done
        # Requests of before that are still there; one that is newer asks for another embedding.
        open_ = _table(now, "embedding_requests").join(asked.select("memory_uuid", "requested_at"), ["memory_uuid", "requested_at"], "left_semi")
        current = index.current_embeddings(made_of.join(open_, "memory_uuid", "left_semi"), _states(now, ids).select(F.col("memory_uuid").alias("uuid"), "state_hash"))
        good = current.where("not conflict and embedding is not null").select("memory_uuid", "embedding", "embedding_model", "embedding_dimension")
        bad = current.where("error is not null").select("memory_uuid", F.col("error").alias("why"))
        failed = open_.join(bad, "memory_uuid").withColumns({"attempts": F.col("attempts") + 1, "error": F.col("why")}).drop("why")
        idle = open_.select("memory_uuid").join(current.where("conflict or embedding is not null or error is not null").select("memory_uuid"), "memory_uuid", "left_anti")
        done = good.count()
        changes = {"embedding_requests": Delta(failed, good.select("memory_uuid").union(idle))}
        return changes | ({"embeddings": Delta(good)} if done else {})

    store.retry(merged)
    release(ids, inputs, made, made_of)
    return done


def refreshes(store: Store, approved: DataFrame, call: Call, model: str, checkpoint: str, dimension: int | None = None, **trigger) -> StreamingQuery:
    """approved (memory_uuid, requested_at) as a stream: each micro-batch's requests are stored, once, and worked off with what is left of earlier ones."""
    from .feed import name_of

    stream = f"embedding-{name_of(checkpoint)}"

    def apply(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("memory_uuid").agg(F.max("requested_at").alias("requested_at"))
        rows = last.select("memory_uuid", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.col("requested_at").cast("timestamp").alias("requested_at"))
        store.retry(lambda seen: {"embedding_requests": Delta(rows)}, (stream, epoch))
        refresh(store, call, model, dimension)

    return approved.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
