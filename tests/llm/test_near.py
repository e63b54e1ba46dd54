"""Fingerprints and near-dedup against brute force, hot groups, and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import minhash, near
from tessera.llm.components import connected_components
from tessera.llm.linking import band_rows
from tessera.llm.near import VALUES
from tessera.llm.shingles import minima, permutations, shingle_hashes, span_hashes, wide_sets, in_common

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def crowd(size, seed):
    """Near copies of one text around the threshold, chains of copies, exact copies and lone texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(80)]
    rows = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            text[rng.randrange(len(text))] = word()
        rows.append(" ".join(text))
    chain = [word() for _ in range(60)]
    for k in range(12):
        chain[5 * k % 60] = word()
        rows.append(" ".join(chain))
    rows += [" ".join(word() for _ in range(50)) for _ in range(30)] + ["a", "A ", "a b", "a b", "", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("find, n, percent", [(near.near_duplicates, 3, 85), (near.near_duplicates, 5, 80), (minhash.similar_documents, 5, 80)])
def test_components(spark, find, n, percent):
    rows = crowd(400, n)
    got = find(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, n, percent)


def test_on_test_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near.near_duplicates(docs, 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 3, 85)


def test_deduplicated_keeps_one_of_each(spark, odd, nothing):
    rows = crowd(50, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.deduplicated(df, 5, 80).collect()) == [i for i, _, _, kept in brute(rows, 5, 80) if kept]
    left = near.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [None, None, 1, 2, 3, 3, 3, 4, 6, 8, -9]))
    assert near.near_duplicates(nothing).count() == 0 and near.near_duplicates(odd).count() == odd.count()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, np.uint64)
    sets = [x[:2000], x[500:], x]
    a, b = permutations(VALUES, 5)
    least = minima(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), a, b)
    sketch = near.SetSketch()
    values = sketch.encode(least)
    assert (sketch.merge(values[0], values[1]) == values[2]).all()
    told = sketch.likeness(values[:1], values[1:2], np.array([2000.0]), np.array([2500.0]))
    assert abs(told[0] - 1500 / 3000) < 0.12
    assert band_rows(0.85, 192) == 6 and band_rows(0.8, 192) == 5 and band_rows(0.8, 128) == 4


def test_hashes_tell_shingles_apart():
    texts = ["a b c d e", "A  b\tc", "", "   ", "x", "a b", "é à ü ß a b c", " a b c d e ", "ab c", "a bc", None]
    from tessera.llm.common import column_buffer

    for n in (1, 3, 5):
        h, b = shingle_hashes(*column_buffer(pa.array(texts)), n)
        got, want = [set(h[b[i] : b[i + 1]].tolist()) for i in range(len(texts))], [shingles(t, n) for t in texts]
        assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(len(texts)))


def swapped(n):
    """Two words of 2^n letters a and b that have equal polynomial hashes modulo 2^64, whatever the odd base, from n = 11 on."""
    word, other = "a", "b"
    for _ in range(n):
        word, other = word + other, other + word
    return word, other


def test_words_that_polynomials_confuse(spark):
    from tessera.llm.common import column_buffer

    for n in (1, 5, 10, 11, 12):
        x, y = swapped(n)
        data, offsets = column_buffer(pa.array([x, y]))
        for table in (0, 1):
            h = span_hashes(data, offsets[:-1], offsets[1:], table=table)
            assert h[0] != h[1]
    x, y = swapped(12)
    rows = [(0, f"{x} {x} {y} {x}"), (1, f"{y} {y} {x} {y}"), (2, f"{y} {y} {x} {y}")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 3, 85)


def test_wide_sets_against_sets_of_words():
    from tessera.llm.common import column_buffer

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "b", "c" * 70, "C" * 70, "d" * 200, "é"]) for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    for n in (1, 3, 5):
        got, want = wide_sets(*column_buffer(pa.array(texts)), n), [shingles(t, n) for t in texts]
        assert [x.shape[1] for x in got] == [len(s) for s in want]
        assert all(in_common(got[i], got[j]) == len(want[i] & want[j]) for i in range(40) for j in range(40))


def test_hubs_are_spread(spark):
    links = [(0, k) for k in range(1, 400)] + [(500 + k, 1000) for k in range(300)] + [(k, k + 1) for k in range(2000, 2040)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), least_hot=20).collect()}
    assert {got[k] for k in range(400)} == {0} and {got[500 + k] for k in range(300)} == {500} and got[1000] == 500 and {got[k] for k in range(2000, 2041)} == {2000}


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + k) for k in range(50)] + [(rng.randrange(20), rng.randrange(20)) for _ in range(30)] + [(None, 1), (5, None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[200 + k] for k in range(50)} == {200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    values = lambda s: np.frombuffer(bytes.fromhex(s), np.uint16)
    off = []
    for k, (i, text) in enumerate(rows):
        j, after = rows[(k + 1) % len(rows)]
        half, r = len(text) // 2, got[i]
        changed = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_next == pytest.approx((values(r.fingerprint) == values(got[j].fingerprint)).mean())
        a, b = shingles(text, 5), shingles(changed, 5)
        assert r.jaccard_edited == (len(a & b) / len(a | b) if a | b else 1.0)
        c = shingles(after, 5)
        assert r.jaccard_next == (len(a & c) / len(a | c) if a | c else 1.0)
        if a | b:
            off.append(abs(r.near_edited - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.05 and max(off) < 0.25
    assert all(r.similar_id == i for i, r in got.items())


def test_the_query_tells_what_documents_are_similar_to(spark, docs):
    got = {r.doc_id: r.similar_id for r in minhash.query(spark, "/root/testdata/sf0.001").collect()}
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5, 80)
    assert got == {r[0]: r[2] for r in want} and any(i != s for i, s in got.items())


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    got = minhash.fingerprints(odd).collect()
    assert len(got) == odd.count()
    assert len({r.fingerprint for r in got if r.n_chars == len("a b")}) == 1
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2, 6, 8)}) == 1
    assert all(r.near_next == 1 for r in got if r.doc_id is None)
    assert minhash.fingerprints(nothing).count() == 0
    one = minhash.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"a b a b ").hexdigest() or one[0].n_chars == 7
