"""The store: deltas, conflicts, revisions, compaction and vacuum; what a search reads of the postings."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, search
from tessera.plans.fixtures import Fixtures
from tessera.sources import store as stores
from tessera.sources.store import ConflictError, Delta, Derived, Store

WORDS = "memory_uuid string, keyword_norm string, weight int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_random_deltas_are_what_a_dictionary_holds(spark, tmp_path, monkeypatch):
    """Replaced, removed and new keys of several rows each; every revision can still be read."""
    monkeypatch.setattr(stores, "DELTAS", 4)
    rng, store, model, states = random.Random(5), Store(spark, str(tmp_path / "s")), defaultdict(list), {}
    frame = lambda keys: spark.createDataFrame([(k, w, n) for k in keys for w, n in model[k]], WORDS)
    for k in range(30):
        model[f"k{k}"] = [(f"w{j}", j) for j in range(rng.randint(1, 3))]
    store.write("keywords", frame(list(model)))
    for turn in range(11):
        put = [f"k{rng.randint(0, 40)}" for _ in range(rng.randint(1, 4))]
        gone = [f"k{rng.randint(0, 40)}" for _ in range(rng.randint(0, 2))]
        gone = [k for k in gone if k not in put]
        for k in put:
            model[k] = [(f"t{turn}-{j}", j) for j in range(rng.randint(1, 2))]
        for k in gone:
            model[k] = []
        seen = store.snapshot()
        store.commit(seen, {"keywords": Delta(frame(sorted(set(put))), spark.createDataFrame([(k,) for k in gone], "memory_uuid string"))})
        states[seen.revision + 1] = sorted((k, w, n) for k in model for w, n in model[k])
    for revision, state in states.items():
        assert rows(store.read("keywords", revision)) == state
    whole = rows(store.read("keywords"))
    store.compact("keywords", whole=True)
    assert rows(store.read("keywords")) == whole and len(store.snapshot().segments("keywords")) == 1
    assert store.vacuum() > 0 and rows(store.read("keywords")) == whole
    with pytest.raises(ValueError, match="no revision"):
        store.read("keywords", 2)


def test_the_second_commit_on_a_revision_fails_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write_all({"keywords": spark.createDataFrame([("a", "x", 1)], WORDS)})
    seen = store.snapshot()
    change = lambda word: {"keywords": Delta(spark.createDataFrame([("a", word, 1)], WORDS)), "units": Delta(spark.createDataFrame([(word,)], "uuid string"))}
    store.commit(seen, change("first"))
    with pytest.raises(ConflictError):
        store.commit(seen, change("second"))
    assert rows(store.read("keywords")) == [("a", "first", 1)] and rows(store.read("units")) == [("first",)]
    tried = []

    def build(now):
        tried.append(now.revision)
        if len(tried) == 1:
            store.commit(now, change("between"))
        return change("third")

    store.retry(build)
    assert len(tried) == 2 and rows(store.read("keywords")) == [("a", "third", 1)]


def test_marks_and_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    put = lambda k: {"units": Delta(spark.createDataFrame([(f"u{k}", k)], "uuid string, v long"))}
    store.retry(lambda seen: put(0), ("stream", 0))
    store.retry(lambda seen: put(1), ("stream", 0))
    store.retry(lambda seen: put(2), ("stream", 1))
    assert [r.uuid for r in store.read("units").orderBy("uuid").collect()] == ["u0", "u2"]
    at = store.snapshot().revision
    store.commit(store.snapshot(), {"units": Delta(gone=spark.createDataFrame([("u0",)], "uuid string"))})
    assert rows(store.snapshot().changed("units", at)) == [("u0",)] and rows(store.snapshot().changed("units", at + 1)) == []
    store.compact("units", whole=True)
    assert store.snapshot().changed("units", at) is None
    assert store.commit(store.snapshot(), {}) == store.snapshot().revision


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return sum(found)


def test_a_search_reads_the_row_groups_of_its_grams(spark, tmp_path):
    """Kept postings are sorted by gram, so a search for a rare word reads a small part of them, and finds what a full pass finds."""
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    store, built = Store(spark, str(tmp_path / "s")), index.build_search_index(fx.units, fx.keywords)
    built = built.withColumn("content_text", F.when(F.col("memory_uuid") == 7, F.concat("content_text", F.lit(" zyzzyva"))).otherwise(F.col("content_text")))
    postings = index.gram_postings(built)
    before = spark.conf.get("parquet.block.size", None)
    spark.conf.set("parquet.block.size", str(64 << 10))
    spark.conf.set("parquet.page.size", str(8 << 10))
    try:
        store.write_all({"search_index": built, "postings": postings, "grams": postings.groupBy("gram").agg(F.count("*").alias("n"))})
    finally:
        spark.conf.unset("parquet.page.size")
        spark.conf.set("parquet.block.size", before) if before else spark.conf.unset("parquet.block.size")
    stored, kept, grams = (store.read(n) for n in ("search_index", "postings", "grams"))
    total = kept.count()
    rare = [r.gram for r in grams.where("n < 30").orderBy("gram").limit(3).collect()]
    assert scanned(kept.where(F.col("gram").isin(rare)).select("memory_uuid")) < total / 10
    one = search.indexed(stored, kept, search.request({"terms": {"include": ["zyzzyva"], "exclude": []}, "filters": ["content"]}), grams=grams)
    assert [r.memory_uuid for r in one.collect()] == [7] and scanned(one) <= 100
    for request in ({"query": "worthless license"}, {"query": "ea"}, {"query": "the"}, {"query": "brand#12 zzzz"}, {"terms": {"include": ["src1", "steel"], "exclude": ["license"]}, "filters": ["keywords"]}, {"terms": {"include": [], "exclude": ["e"]}, "filters": ["title"]}):
        wanted = search.request(request)
        want = rows(search.literal(built, wanted, limit=False).select("memory_uuid", "matched_fields", F.round("score", 9)))
        assert rows(search.indexed(stored, kept, wanted, limit=False, grams=grams).select("memory_uuid", "matched_fields", F.round("score", 9))) == want
        assert rows(search.indexed(stored, kept, wanted, limit=False).select("memory_uuid", "matched_fields", F.round("score", 9))) == want


def test_a_table_made_of_another_one_reads_what_is_written(spark, tmp_path):
    """Counts of grams come from the stored postings in the same commit, so texts are taken apart once and not for samples and counts again."""
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    built = index.build_search_index(*(getattr(Fixtures(spark, "/root/testdata/sf0.001"), n) for n in ("units", "keywords")))
    postings = index.gram_postings(built)
    store = Store(spark, str(tmp_path / "s"))
    store.write_all({"postings": postings.mapInArrow(once, postings.schema), "grams": Derived("postings", index.gram_counts)})
    assert store.revisions() == [1] and seen.value == postings.count()
    assert rows(store.read("grams")) == rows(postings.groupBy("gram").agg(F.count("*").alias("n")))


def test_a_search_makes_postings_once(spark, monkeypatch):
    """Postings that no store keeps are made for what is found, and not again to join it with the index."""
    monkeypatch.setattr(search, "LOOKED_UP", 2)
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    built = index.build_search_index(*(getattr(Fixtures(spark, "/root/testdata/sf0.001"), n) for n in ("units", "keywords")))
    postings = index.gram_postings(built)
    wanted = search.request({"query": "worthless license"})
    got = rows(search.indexed(built, postings.mapInArrow(once, postings.schema), wanted).select("memory_uuid", F.round("score", 9)))
    assert len(got) > 2 and got == rows(search.literal(built, wanted).select("memory_uuid", F.round("score", 9)))
    assert seen.value == postings.count()
