"""Spelling variants against brute force and their SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessera.llm import variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute_counts(rows, spoil):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return total


def brute(rows, spoil=None, least=5, count=3):
    n = {w: k for w, k in brute_counts(rows, spoil).items() if len(w) >= least and k >= count}
    near = {w: [u for u in n if one_edit(w, u)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df, **options):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("alphabet", ["ab", "abcé", "aÀÿz"])
def test_random_words(spark, seed, alphabet):
    """Dense words over few characters: rows of equal ones, words that are beginnings of others, chains of forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(250)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=80))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, least_chars=2, least_count=1) == brute(rows, None, 2, 1)
    assert found(df, spoil=3, least_chars=1, least_count=2) == brute(rows, 3, 1, 2)


def test_hot_roots_and_nodes(spark, monkeypatch):
    monkeypatch.setattr(variants, "HOTTEST", 2)
    monkeypatch.setattr(variants, "HOT_ROOTS", 1)
    base = "receive " * 40 + "recieve " * 15 + "recive " * 15 + "receve " * 7 + "recve " * 3 + "deceive " * 9 + "receiver " * 4
    rows = [(1, base), (2, "receive received receives reception " * 5)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)
    assert {r[2] for r in got if r[0] == "recve"} == {"receive"}


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, spoil=variants.SPOILT, least_chars=1, least_count=1) == brute(rows, variants.SPOILT, 1, 1)
    assert found(nothing) == set()


def test_very_long_words(spark):
    long = "x" * 30_000
    rows = [(i, f"{long} {long}y {long[1:]}") for i in range(3)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_counts_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 5)
    rows = [(i, "alpha beta gamma delta epsilon zeta eta theta " * 3) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {(r.word, r.n) for r in variants.counted(df, 5).collect()} == set(brute_counts(rows, 5).items())


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    got = variants.query(spark, path)
    rel = db.sql(f"SELECT {', '.join(got.columns)} FROM ({variants.ORACLE})")
    rows = got.collect()
    assert rows and sorted(map(str, map(tuple, rows))) == sorted(map(str, rel.fetchall()))
