"""The Merkle manifest against brute force and its SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    """The root, and each node's siblings."""
    sibs, at = [""] * len(nodes), [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, places = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k : k + 16]
            for j in range(len(run)):
                for i in at[k + j]:
                    sibs[i] += "".join(run[:j] + run[j + 1 :])
            up.append(h("".join(run)))
            places.append([i for j in range(len(run)) for i in at[k + j]])
        nodes, at = up, places
    return nodes[0], sibs


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, verified."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, kept = [], []
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, sibs = climbed([leaf(r) for r in own])
        subs.append(sub)
        kept.append((own, sibs))
    root, above = climbed(subs)
    out = Counter()
    for (own, sibs), sub, more in zip(kept, subs, above, strict=True):
        for r, sib in zip(own, sibs, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            out[r[0], leaf(r), sub, root, h(sib + more), not (hit and r[4].translate(LOW) != r[4])] += 1
    return out


def found(df):
    made = merkle.build(df, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in merkle.proofs(made).collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [300, 1, 17, 256], [1] * 40 + [257]])
def test_sizes(spark, sizes):
    rows = [(1000 * s + i, None if s == 1 else f"s{s}é", "en", i, f"Text {i}") for s, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows)
    assert found(nothing) == Counter()


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert found(df) == brute([(1, None, None, None, "a"), (2, None, None, None, "b")])


def test_fragments_merge_in_any_order():
    """The monoid: however leaves are dealt to fragments, and however these are merged, the runs are the same."""
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(700)]
    whole = merkle.Forest(2)
    for i, d in enumerate(digests):
        whole.add(i % 2, 350, 0, i // 2, d, 0)
    assert not whole.open
    rng = random.Random(7)
    for _ in range(5):
        parts = [merkle.Forest(2) for _ in range(6)]
        for i in rng.sample(range(700), 700):
            rng.choice(parts).add(i % 2, 350, 0, i // 2, digests[i], 0)
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            both = merkle.Forest(2)
            for part in (a, b):
                both.done += part.done
                for tree, level, run, place, nodes, at, digest in part.unresolved():
                    both.add(tree, nodes, level, run * 16 + place, digest, at)
            parts.append(both)
        assert not parts[0].open
        assert sorted(parts[0].done) == sorted(whole.done)


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 2)
    rows = [(i, f"s{i % 3}", None, None, f"T{i}") for i in range(900)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_joined_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGES", 0)
    rows = [(i, f"s{i % 3}" if i % 5 else None, None, None, f"T{i}") for i in range(200)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    got = merkle.query(spark, path)
    rel = db.sql(f"SELECT {', '.join(got.columns)} FROM ({merkle.ORACLE})")
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
