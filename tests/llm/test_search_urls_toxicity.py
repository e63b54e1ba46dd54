"""Nearest neighbours, URL filters and toxicity: brute force, SQL, held-out accuracy, odd rows."""

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ivfpq, toxicity, url_rules


def exact(ids, x, top=20):
    out = {}
    for k in np.flatnonzero(ids % 20 == 0):
        score = np.zeros(len(ids))
        for d in range(x.shape[1]):
            score += x[k, d] * x[:, d]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[k]][:top]
        out[int(ids[k])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64))
    got = found(ivfpq.query(spark, f"/root/testdata/{sf}"))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    scores = {q: dict(v) for q, v in want.items()}
    hits = [v in scores[q] for q, found_ in got.items() for v, _ in found_]
    assert np.mean(hits) >= 0.9
    assert all(s == pytest.approx(scores[q][v], abs=1e-12) for q, found_ in got.items() for v, s in found_ if v in scores[q])


def test_hot_vector_ranks_small_ids_first(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    got, want = found(ivfpq.search(df, recall=1.0)), exact(np.arange(600), x.astype(np.float64))
    assert [v for v, _ in got[0]] == [v for v, _ in want[0]]
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) > 0.97


@pytest.mark.parametrize("noise", [0.001, 0.05])
def test_recall_within_near_copies(spark, noise):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8000, 16))
    group = np.arange(8000) % 25 == 0
    x[group] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[group] += noise * rng.normal(size=(group.sum(), 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(ivfpq.search(df)), exact(np.arange(8000), x)
    share = {q: len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want}
    assert np.mean([s for q, s in share.items() if group[q]]) > 0.99
    assert np.mean([s for q, s in share.items() if not group[q]]) > 0.9


def test_clusters_are_probed_by_few_lists():
    """Lists grow with the number of vectors, probes only as far as the data needs them."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (1000, 4000, 16_000):
        x = rng.normal(size=(n // 100, 24))[np.arange(n) % (n // 100)] + 0.1 * rng.normal(size=(n, 24))
        index = ivfpq.fit(x, round(n**0.5))
        shares.append(ivfpq.probes_for(index, x, 20) / len(index.centroids))
    assert shares[2] < 0.25 and shares[2] < shares[0]


def test_each_query_gets_its_twenty(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 6)), 50 * rng.normal(size=(400, 6))[:1].repeat(400, 0)])
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    assert all(len(v) == 20 for v in found(ivfpq.search(df)).values())


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (1, [2.0, 1.0]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (6, [1.0, 5.0]), (7, []), (60, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, list string")
    assert found(ivfpq.search(df)) == {0: [(1, 2.0), (6, 1.0), (60, 0.5)], 60: [(6, 3.0), (1, 1.5), (0, 0.5)]}
    assert ivfpq.search(df.where("false")).count() == 0
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert ivfpq.search(alone).count() == 0


def brute_url(url):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


URLS = [
    "http://example.com/en/7", "https://A.EXAMPLE.com/en/745?x#y", "http://example.com/en/8", "http://notexample.com/en/7", "http://com/en/", "http://com/en", "ftp://x.net/de/", "x.net/de/",
    "http://example.net/de/81", "http://example.net.evil/de/8", "http://org?/es/", "http://org/es/#a", "http://a.org//es/", "://net/de/", "http://", "", None, "http://u@x.org/es/a://b.com/en/", "http://É.Org/es/é",
    "http://x.com/EN/", "http://casino.example.org/", "http://my-casino-win.example.org/a", "http://x/ads/y", "http://x.com\n/en/",
]


def test_urls(spark):
    rows = [(k, u, "clash", "clash") for k, u in enumerate([*URLS, URLS[0]])]
    got = {r.page_id: r for r in url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()}
    for k, u, *_ in rows:
        host, path, rule, verdict = brute_url(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        plain = any(re.search(w.pattern, host + path) for w in url_rules.WORDS)
        assert got[k].verdict == (verdict or ("block" if plain else "allow")), u
    assert url_rules.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet')")
    rel = db.sql(f"SELECT page_id, host, path, rule, verdict, pattern FROM ({url_rules.ORACLE})")
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in url_rules.query(spark, path).collect())


def test_only_candidates_run(monkeypatch):
    index = url_rules.RuleIndex(list(url_rules.SITES + url_rules.WORDS), {"com": 100, "en": 90, "example": 95, "de": 3, "net": 50})
    assert {t for t in index.by_token} >= {"en", "de", "es"} and not index.always


def test_held_out_toxicity(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    got = toxicity.judge(docs.where("doc_id % 3 = 0"), model).withColumnRenamed("toxic", "said").join(labels, "doc_id").select("said", "toxic", "expected_severity").collect()
    bad = [r for r in got if r.toxic == 1]
    assert np.mean([r.said for r in bad]) > 0.9
    assert np.mean([r.said for r in got if r.toxic == 0]) < 0.01
    assert (np.diff(model.thresholds) > 0).all()
    assert np.mean([r.expected_severity for r in bad]) > 1


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    texts = [" ".join([f"w{rng.integers(300)}" for _ in range(20)] + [f"bad{k}" for k in range(g * 2)]) for g in (g for g in range(4) for _ in range(150))]
    grades = np.repeat(np.arange(4), 150)
    keys, counts, bounds = toxicity.counted(pa.array(texts))
    model = toxicity.fit(keys, counts, bounds, grades, 3)
    score = model.score(pa.array(texts))
    assert np.mean(model.grades(score).argmax(1) == grades) > 0.95
    assert model.grades(score).sum(1) == pytest.approx(np.ones(len(texts)))


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.judge(odd, model)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns)
    assert all(r.expected_severity is not None and math.isfinite(r.expected_severity) for r in rows)
    assert toxicity.judge(nothing, model).count() == 0
    none = toxicity.train(odd, labels.where("false"))
    assert not any(r.toxic for r in toxicity.judge(odd, none).select(F.col("toxic")).collect())


def test_scores_against_brute_force(spark, docs):
    """Words, counts, weights and probabilities, each by their formula on plain strings."""
    model = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for r in toxicity.judge(docs, model).collect():
        counts = {}
        for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", r.text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            counts[w] = counts.get(w, 0) + 1
        known = {w: weight[h] for w in counts if (h := int(toxicity.features(pa.array([w]))[0][0])) in weight}
        score = sum(v * (1 + math.log(counts[w])) for w, v in known.items())
        above = [1.0, *(sigmoid(score - t) for t in model.thresholds), 0.0]
        grades = [a - b for a, b in zip(above, above[1:], strict=False)]
        severity = sum(k * p for k, p in enumerate(grades))
        assert r.expected_severity == pytest.approx(severity, abs=1e-9) and r.severity_grade == grades.index(max(grades))
        assert r.toxic_words == sum(v > 0 for v in known.values()) and r.toxic == (severity >= toxicity.REJECT and score > 0)


def test_copies_of_a_labelled_text_count_once(spark):
    rows = [(k, f"word{k % 7} calm{k}") for k in range(60)] + [(100 + k, "vile words here") for k in range(40)]
    labels = [(i, 1, int(i >= 100)) for i, _ in rows]
    df, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    copied, single = toxicity.train(df, told), toxicity.train(df.where("doc_id <= 100"), told)
    assert copied.keys.tolist() == single.keys.tolist() and copied.weights == pytest.approx(single.weights)
