"""Stores, the feed as a stream, the sweep, and providers."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import commands, index
from tessera.operators.review import expired
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import RETENTION, as_of
from tessera.sources import config, providers
from tessera.sources.store import Delta, Store
from tessera.streaming import embedding, feed
from tessera.streaming.throttle import throttled

SF = "/root/testdata/sf0.001"


def test_feed_in_micro_batches_is_the_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('signup', 'click', 'error')")
    edits = e.select(F.col("user_id").alias("memory_uuid"), F.col("event_id").alias("order_id"), F.col("event_type").alias("action"), F.col("props").alias("before_state"), F.col("props").alias("after_state"), "ts")
    for k in range(3):
        edits.where(f"order_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    feed.open_changes(store, stream, str(tmp_path / "cp")).awaitTermination()
    got = {r.memory_uuid: r.after_state for r in store.read("changes").collect()}
    assert got == {r.memory_uuid: r.after_state for r in commands.change_baseline(edits).collect()}


def test_index_refresh_and_sweep(spark, tmp_path):
    fx, store = Fixtures(spark, SF), Store(spark, str(tmp_path / "store"))
    store.write_all({"units": fx.units, "keywords": fx.keywords, "relations": fx.relations, "changes": fx.changes, "search_index": index.build_search_index(fx.units, fx.keywords)})
    fx.units.select("uuid").where("uuid % 3 = 0").write.parquet(str(tmp_path / "touched"))
    stream = spark.readStream.schema("uuid long").parquet(str(tmp_path / "touched"))
    feed.index_refresh(store, stream, str(tmp_path / "cp")).awaitTermination()
    built = index.build_search_index(fx.units, fx.keywords)
    assert store.read("search_index").exceptAll(built).isEmpty()
    n = feed.sweep(store, as_of(), RETENTION)
    left = store.read("units")
    assert left.count() == fx.units.count() - n
    assert store.read("keywords").join(left.select(F.col("uuid").alias("memory_uuid")), "memory_uuid", "left_anti").count() == 0 or n == 0
    assert feed.sweep(store, as_of(), RETENTION) == 0


def test_two_sweeps_of_equal_size(spark, tmp_path):
    fx, store = Fixtures(spark, SF), Store(spark, str(tmp_path / "store"))
    late = F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00"))
    first, second = (r.uuid for r in fx.units.orderBy("uuid").limit(2).collect())
    trashed = F.col("uuid").isin(first, second)
    units = fx.units.withColumn("status", F.when(trashed, "trashed").otherwise(F.col("status"))).withColumn("trashed_at", F.when(trashed, as_of()).otherwise(F.col("trashed_at")))
    change = fx.changes.where("action = 'delete'").limit(1)
    store.write_all({"units": units, "keywords": fx.keywords, "changes": change.withColumn("memory_uuid", F.lit(first))})
    assert feed.sweep(store, late, RETENTION) == 1
    store.write("changes", change.withColumn("memory_uuid", F.lit(second)))
    assert feed.sweep(store, late, RETENTION) == 1
    assert store.read("units").where(F.col("uuid").isin(first, second)).isEmpty()
    assert store.read("keywords").where(F.col("memory_uuid").isin(first, second)).isEmpty() and store.read("changes").isEmpty()


def test_store_without_versions(spark, tmp_path):
    failed = []
    assert feed.sweep(Store(spark, str(tmp_path / "none")), as_of(), 1, failed.append) == 0 and failed


def test_providers(spark):
    assert providers.embedding([{"index": 0, "embedding": [[1, 2]]}]) == providers.embedding({"data": [{"embedding": [1, 2]}]}, 2) == [1.0, 2.0]
    for bad in ([], {"data": []}, [{"embedding": []}]):
        with pytest.raises(providers.ProviderError):
            providers.embedding(bad)
    assert providers.ranks([{"index": 1, "score": 0.5}, {"index": 0, "relevance_score": 0.2}], 2) == [(1, 0.5), (0, 0.2)]
    with pytest.raises(providers.ProviderError):
        providers.ranks([{"index": 2, "score": 0.5}], 2)
    inputs = spark.createDataFrame([(1, "x" * 600), (2, "short")], "memory_uuid long, text string")
    rows = providers.embed(inputs, lambda texts: [[float(len(t)), 0.0] for t in texts], "m", 2).collect()
    assert {r.memory_uuid: r.embedding for r in rows} == {1: [1.0, 0.0], 2: [5.0, 0.0]}


def brute_throttle(attempts, capacity):
    """The same book as a plain dictionary."""
    entries, pruned, out = {}, 0, []
    for i, at, address, device, good in attempts:
        if at - pruned >= 60:
            entries, pruned = {k: e for k, e in entries.items() if e["expires"] > at}, at
        ids = [f"ip:{address}", f"device:{device}"]
        until = next((entries[k]["until"] for k in ids if k in entries and entries[k]["until"] > at), 0)
        if until:
            out.append((i, "locked", max(1, until - at)))
        elif good:
            for k in ids:
                entries.pop(k, None)
            out.append((i, "accepted", 0))
        else:
            locked = 0
            for k in ids:
                if locked:
                    break
                if k not in entries and len(entries) >= capacity:
                    free = [(e["expires"], x) for x, e in entries.items() if e["until"] <= at]
                    if not free:
                        continue
                    entries.pop(min(free)[1])
                e = entries.setdefault(k, {"n": 0, "until": 0, "expires": 0})
                if e["until"]:
                    e.update(n=0, until=0)
                e["n"], e["expires"] = e["n"] + 1, at + 3600
                if e["n"] >= 5:
                    locked = e["until"] = at + 3600
            out.append((i, "locked", 3600) if locked else (i, "refused", 0))
    return out


@pytest.mark.parametrize("capacity", [10_000, 6])
def test_throttle_is_the_loop(spark, tmp_path, capacity):
    rng, at, rows = random.Random(capacity), 1_700_000_000, []
    for i in range(600):
        at += rng.choice((0, 1, 5, 30, 400, 2000 if i % 50 == 0 else 1))
        rows.append((f"s{rng.randrange(2)}", i, at, f"a{rng.randrange(5)}", f"d{rng.randrange(8)}", rng.random() < 0.1))
    for k in range(3):  # one file a micro-batch, in order
        df = spark.createDataFrame(rows[200 * k : 200 * k + 200], "server string, attempt_id long, at long, address string, device string, good boolean")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = throttled(stream, capacity).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        out.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.server, r.attempt_id): (r.decision, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(s, i): (d, n) for s in ("s0", "s1") for i, d, n in brute_throttle([r[1:] for r in rows if r[0] == s], capacity)}
    assert got == want and {d for d, _ in got.values()} == {"accepted", "refused", "locked"}


def flaky(texts):
    """A provider that fails for some texts, and returns too few vectors for others."""
    if any("broken" in t for t in texts):
        raise OSError("unreachable")
    return [[1.0, float(len(t))] for t in texts]


def small_store(spark, path, names):
    """Active records (uuid is the title) with a keyword each."""
    at = datetime(2024, 1, 9, 12)
    units = spark.createDataFrame([(n, "core", n, f"content of {n}", None, 1, "active", None, None, at, at) for n in names], schemas.UNITS)
    words = spark.createDataFrame([(n, "k", None) for n in names], schemas.KEYWORDS)
    store = Store(spark, path)
    store.write_all({"units": units, "keywords": words})
    return store


def test_embeddings_follow_approvals_as_a_stream(spark, tmp_path):
    store = small_store(spark, str(tmp_path / "store"), ["one", "two", "broken one", "gone later"])
    asked = [("one",), ("two",), ("broken one",), ("never there",), ("one",)]
    spark.createDataFrame(asked, "memory_uuid string").withColumn("requested_at", F.to_timestamp(F.lit("2024-01-09 12:00:00"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a stream that is started again doesn't ask again
        stream = spark.readStream.schema("memory_uuid string, requested_at timestamp").parquet(str(tmp_path / "in"))
        embedding.refreshes(store, stream, flaky, "m", str(tmp_path / "cp"), dimension=2).awaitTermination()
    got = {r.memory_uuid: (list(r.embedding), r.embedding_model, r.embedding_dimension) for r in store.read("embeddings").collect()}
    assert set(got) == {"one", "two"} and got["one"][1:] == ("m", 2)
    left = store.read("embedding_requests").collect()
    assert [(r.memory_uuid, r.attempts) for r in left] == [("broken one", 1)] and "unreachable" in left[0].error
    for k in (2, 3, 3):
        assert embedding.refresh(store, flaky, "m", 2) == 0
        assert store.read("embedding_requests").first()["attempts"] == k


def test_a_state_that_changes_while_it_is_embedded_stays_requested(spark, tmp_path, monkeypatch):
    store = small_store(spark, str(tmp_path / "store"), ["one", "two"])
    requests = spark.createDataFrame([("one", 0, None, datetime(2024, 1, 9)), ("two", 0, None, datetime(2024, 1, 9))], schemas.EMBEDDING_REQUESTS)
    store.retry(lambda seen: {"embedding_requests": Delta(requests)})
    real = embedding.providers.embed

    def meanwhile(*args):
        made = real(*args)
        edited = store.read("units").where("uuid = 'two'").withColumn("content", F.lit("edited meanwhile"))
        store.retry(lambda seen: {"units": Delta(edited)})
        return made

    monkeypatch.setattr(embedding.providers, "embed", meanwhile)
    assert embedding.refresh(store, flaky, "m") == 1
    assert [r.memory_uuid for r in store.read("embeddings").collect()] == ["one"]
    assert [(r.memory_uuid, r.attempts) for r in store.read("embedding_requests").collect()] == [("two", 0)]
    monkeypatch.undo()
    assert embedding.refresh(store, flaky, "m") == 1 and store.read("embedding_requests").count() == 0
    assert embedding.refresh(store, lambda texts: [[1.0]] * (len(texts) + 1), "m") == 0


def test_all_stores_are_swept_now_and_then(spark, tmp_path):
    """One store is missing and one is broken; the others are swept, at the start and at each tick."""
    at = datetime(2024, 1, 1)
    for name in ("a", "b", "broken"):
        store = small_store(spark, str(tmp_path / name), ["old", "young", "kept"])
        trashed = store.read("units").where("uuid <> 'kept'").withColumn("status", F.lit("trashed")).withColumn("trashed_at", F.when(F.col("uuid") == "old", F.lit(at)).otherwise(F.lit(datetime(2024, 1, 9, 11, 59))))
        changes = spark.createDataFrame([(n, "delete", None, None, at, at) for n in ("old", "young")], schemas.CHANGES)
        store.retry(lambda seen, t=trashed, c=changes: {"units": Delta(t), "changes": Delta(c)})
    for f in (tmp_path / "broken" / "units").rglob("*.parquet"):
        f.write_bytes(b"nonsense")
    text = "[cleanup]\ntrash_retention_minutes = 1440\nsweep_interval_minutes = 0\n[profiles]\n" + "".join(f'{n} = "{tmp_path / n}"\n' for n in ("a", "broken", "missing", "b"))
    clock, failed = [datetime(2024, 1, 9, 12)], []
    stream = feed.sweeps(spark, lambda: config.parse(text), lambda: clock[0], str(tmp_path / "cp"), lambda name, e: failed.append(name), every="1 second")
    try:
        ids = lambda n: {r.uuid for r in Store(spark, str(tmp_path / n)).read("units").collect()}
        assert ids("a") == ids("b") == {"young", "kept"} and {"broken", "missing"} <= set(failed)
        clock[0] = datetime(2024, 1, 10, 12)
        end = time.time() + 60
        while time.time() < end and not (ids("a") == ids("b") == {"kept"}):
            time.sleep(0.5)
        assert ids("a") == ids("b") == {"kept"} and stream.isActive
    finally:
        stream.stop()
    assert Store(spark, str(tmp_path / "a")).read("keywords").count() == 1
