"""Packing: exact round trips, no gaps, little padding."""

import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


def check(rows, texts, encoder, size):
    """rows: pieces; texts: those of each doc_id; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    pad = total = 0
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        total += at
        pad += 0 if at & (at - 1) == 0 else size - at
    assert set(by_doc) == set(texts)
    for i, own in texts.items():
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in own]
        cover = defaultdict(int)
        for r in by_doc[i]:
            fits = [w for w in want if len(w) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *w[r.start : r.start + r.length])) == r.ids_crc32]
            assert fits
            for k in range(r.start, r.start + r.length):
                cover[r.doc_tokens, k] += 1
        lengths = [len(w) for w in want]
        assert cover == {(n, k): lengths.count(n) for n in set(lengths) for k in range(n)}
    return pad / total if total else 0


def test_documents(spark, docs, encoder):
    texts = {r.doc_id: [r.text] for r in docs.collect()}
    assert check(packing.pack(docs.repartition(6)).collect(), texts, encoder, 1024) < 0.02


def test_many_partitions_merge_in_rounds(spark, docs, encoder, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    texts = {r.doc_id: [r.text] for r in docs.collect()}
    assert check(packing.pack(docs.repartition(11), 256).collect(), texts, encoder, 256) < 0.05


def test_odd_rows(odd, nothing, encoder):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    check(packing.pack(odd).collect(), texts, encoder, 1024)
    assert packing.pack(nothing).count() == 0


def test_one_short_document_needs_no_padding(spark, encoder):
    df = spark.createDataFrame([(1, "a few words, no more")], "doc_id long, text string")
    assert check(packing.pack(df).collect(), {1: ["a few words, no more"]}, encoder, 1024) == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\xa0　 \x85\x1c<|'sé1,.aBЖ日\U0001f600"), st.characters(codec="utf-8"))), min_size=1, max_size=5))
def test_units_give_the_ids_of_whole_texts(texts):
    import pyarrow as pa

    e = encoder_once()
    got = e.encode_all(pa.array(texts, pa.string()))
    assert got == [struct.pack(f"<{len(x)}I", *x) for x in (e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)]


_ENCODER = []


def encoder_once():
    if not _ENCODER:
        _ENCODER.append(packing.Encoder())
    return _ENCODER[0]


def test_words_that_polynomials_confuse(spark, encoder):
    from .test_near import swapped

    x, y = swapped(11)
    texts = {0: [f"one {x} two {y} {x}"], 1: [f"{y} {x}\n{y}"]}
    df = spark.createDataFrame([(i, t[0]) for i, t in texts.items()], "doc_id long, text string").coalesce(1)
    check(packing.pack(df).collect(), texts, encoder, 1024)


def test_equal_hashes_are_compared(encoder, monkeypatch):
    """Even a hash that tells nothing apart gives the tokenizer's ids."""
    import numpy as np
    import pyarrow as pa

    texts = ["one two three", "four  five\nsix", "", "one"]
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, stops, lower: np.zeros(len(starts), np.uint64))
    assert encoder.encode_all(pa.array(texts)) == [struct.pack(f"<{len(x)}I", *x) for x in (encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)]


def test_long_texts_take_time_in_proportion():
    import time

    took = []
    for n in (1_000_000, 10_000_000):
        packer, began = packing.Packer(1024, 0), time.perf_counter()
        packer.place(1, 0, bytes(4 * n), n)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1 and sum(r[2] for r in packer.out) + sum(w[0] for w in packer.open) == 10_000_000
