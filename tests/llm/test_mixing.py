"""Mixing: targets, words taken, positions, the mixed corpus, its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import curriculum


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Reshare by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def check(df):
    rows = df.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += count(r.text)
    want = targets(sizes)
    got = curriculum.mix_sources(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, count(r.text)) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or -1e-9 <= r.position <= 1 + 1e-9)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    return got


def test_documents(docs):
    check(docs)


def test_hot_source(spark):
    rows = [(k, "a b c " * (k % 7), "src0" if k % 3 else f"src{k % 11}") for k in range(900)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_odd_rows(odd, nothing):
    check(odd)
    assert curriculum.mix_sources(nothing).count() == 0
    assert curriculum.training_order(nothing).count() == 0
    mixed = curriculum.training_order(odd)
    assert mixed.columns == odd.columns
    taken = Counter()
    for r in curriculum.mix_sources(odd).collect():
        taken[r.doc_id] += r.taken
    used = Counter()
    for r in mixed.collect():
        used[r.doc_id] += count(r.text)
    assert +used == +taken


def test_reruns_agree(docs):
    a, b = (sorted((r.doc_id, r.taken, r.position or 0) for r in curriculum.mix_sources(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_training_order(docs):
    plan = {r.doc_id: r.taken for r in curriculum.mix_sources(docs).collect()}
    got = defaultdict(int)
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in curriculum.training_order(docs).collect():
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] += count(r.text)
    assert got == {i: n for i, n in plan.items() if n}


def test_inverse_of_demand(spark):
    for begin, end in curriculum.RAMPS:
        t = [k / 10 for k in range(11)]
        u = [begin * x + (end - begin) / 2 * x * x for x in t]
        df = spark.createDataFrame([(x,) for x in u], "u double").select(curriculum._inverse(F.lit(begin), F.lit(end), F.col("u")))
        assert [r[0] for r in df.collect()] == pytest.approx(t)


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    want = sorted(db.sql(f"SELECT doc_id, size, source_size, target, taken, position FROM ({curriculum.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in curriculum.query(spark, path).collect())
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
