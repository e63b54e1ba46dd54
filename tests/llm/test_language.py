"""Language identification against a plain reckoning of the same model, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language

SCHEMA = "doc_id long, text string, lang string"


def grams(text):
    """Runs of one to three of a text's letters and marks, by their code points."""
    out, last = [0], 0
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        code = ord(low) if c.isalpha() else 0
        if code or last:
            out.append(code)
        last = code
    if last:
        out.append(0)
    return [tuple(out[i : i + n]) for n in (1, 2, 3) for i in range(len(out) - n + 1) if n > 1 or out[i]]


def bucket(gram):
    key = sum(c * int(o) for c, o in zip(gram, language.ODD, strict=False)) + len(gram)
    return (key * int(language.ODD[3]) & (1 << 64) - 1) >> 64 - language.BITS


def brute(learnt, texts):
    """Language and probability of texts, learnt from (text, lang)."""
    counts, docs = defaultdict(Counter), Counter()
    for text, lang in learnt:
        if lang is not None:
            counts[lang].update(bucket(g) for g in grams(text))
            docs[lang] += 1
    unit, size = language.UNIT, 1 << language.BITS
    total = {x: sum(counts[x].values()) for x in docs}
    log = lambda x, b: round(math.log((counts[x][b] + language.SMOOTH) / (total[x] + language.SMOOTH * size)) * unit)
    out = []
    for text in texts:
        own = Counter(bucket(g) for g in grams(text))
        if not docs or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        score = {x: round(math.log(docs[x] / sum(docs.values())) * unit) + sum(n * log(x, b) for b, n in own.items()) for x in sorted(docs)}
        best = max(score, key=score.get)
        out.append((best, 1 / sum(math.exp((s - score[best]) / unit) for s in score.values())))
    return out


def agree(df, learnt):
    rows = language.identify(df, language.learn(learnt)).collect()
    want = brute([(r.text, r.lang) for r in learnt.collect()], [r.text for r in rows])
    assert [r.lang_pred for r in rows] == [w[0] for w in want]
    assert [r.score for r in rows] == pytest.approx([w[1] for w in want], abs=1e-6)
    return rows


TEXTS = [("the cat sat on the mat", "en"), ("le chat est là", "fr"), ("der Hund ist groß", "de"), ("Στον ουρανό", "el"), ("", "fr"), (None, "de"), ("the dog", "en"), ("İstanbul ǅ x", "tr"), ("no language", None)]
ASKED = ["the mat", "chat là", "groß", "ουρανό", "", None, "12 34 !?", "x", "the", "の 語", "THE CAT", "ab" * 3]


@pytest.mark.parametrize("block", [2, 128])
def test_model(spark, block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    learnt = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(TEXTS)], SCHEMA)
    asked = spark.createDataFrame([(i, t, None) for i, t in enumerate(ASKED)], SCHEMA)
    rows = agree(asked, learnt)
    assert [r.lang_pred for r in rows[:4]] == ["en", "fr", "de", "el"] and [r.lang_pred for r in rows[4:7]] == ["und"] * 3


def test_odd_rows(odd, nothing, spark):
    learnt = spark.createDataFrame([(1, "some lost words here w1 w2", "en"), (2, "d'autres mots ici é ü", "fr")], SCHEMA)
    rows = agree(odd.withColumn("score", F.lit("theirs")).drop("lang"), learnt)
    assert "kept_text" in rows[0].asDict()
    assert language.identify(nothing, language.learn(learnt)).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(odd, language.learn(nothing)).collect()} == {("und", 0.0)}


def test_parts_of_texts_add_up(monkeypatch):
    """A long text's score doesn't depend on how its features are dealt with, nor on its neighbours."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdeé .ß"), n)) for n in (5000, 1, 0, 37, 2000)]
    column = pa.array(texts)
    whole = language.counted(column, np.arange(5), 5)
    known = language.Languages(["a", "b"], rng.integers(-(1 << 24), 0, ((1 << language.BITS) + 1, 2)).astype(np.int32), np.array([-5, -9]))
    known.logs[-1] = 0
    scores = known.scores(column)[0]
    for size in (1, 7, 64, 4999):
        monkeypatch.setattr(language, "AT_ONCE", size)
        assert (language.counted(column, np.arange(5), 5) == whole).all()
        assert (known.scores(column)[0] == scores).all()
    monkeypatch.undo()
    assert (np.vstack([known.scores(pa.array([t]))[0] for t in texts]) == scores).all()


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = language.query(spark, path)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert len(held) > 200 and right / len(held) >= 0.97, (right, len(held))
