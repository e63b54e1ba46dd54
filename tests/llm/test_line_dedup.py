"""Line dedup against brute force and its SQL."""

from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import lines

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    order = lambda i: (i is not None, i or 0)
    keep = {k: max(v, key=order) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = Counter()
    for i, text in rows:
        parts = (text or "").split("\n")
        left = [x for x in parts if key(x) not in keep or keep[key(x)] == i]
        out[i, len(parts), len(parts) - len(left), "\n".join(left)] += 1
    return out


def found(df, **options):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(df, **options).collect())


LINE = "A line that many documents hold"
PLANTED = [
    (1, f"{LINE}\nown one"), (2, f"  {LINE.upper()}\t\nx\n{LINE}"), (3, f"y\n{LINE}\r"), (9, LINE), (4, "twice only, but long enough"), (5, "twice only, but long enough"),
    (6, "ÉTÉ " + "à" * 20), (7, "été " + "à" * 20), (8, "short\nshort"), (10, "short"), (11, "short"), (12, "z" * 20), (13, "z" * 20), (14, "Z" * 20), (15, ""), (16, None), (17, "\n"),
]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_planted(spark, batches):
    assert found(spark.createDataFrame(PLANTED, "doc_id long, text string"), batches=batches) == brute(PLANTED)


def test_odd_rows(odd, nothing):
    df = odd.withColumn("text", F.concat_ws("\n", F.lit("the same long line in all of them"), "text"))
    got = lines.dedup_lines(df)
    assert set(got.columns) >= set(df.columns)
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert lines.dedup_lines(nothing).count() == 0


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    rel = db.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.ORACLE})")
    assert sorted(map(tuple, lines.query(spark, path).collect())) == sorted(rel.fetchall())


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_batches_in_any_order(spark, order):
    """Later batches may hold newer documents: counts and greatest ids stay right."""
    keys = [(d, k) for d in range(30) for k in range(12) if d % (k + 1) == 0]
    groups = [[x for x in keys if x[0] // 6 == g] for g in range(5)]
    groups = {"up": groups, "down": groups[::-1], "mixed": [groups[g] for g in (2, 0, 4, 1, 3)]}[order]
    runs = lines.LineRuns(3)
    for g in groups:
        runs.add(spark.createDataFrame([(d, k, -k) for d, k in g], "doc_id long, a long, b long"))
    want = {k: max(d for d, j in keys if j == k) for k in range(12) if sum(j == k for _, j in keys) >= 3}
    assert {r.a: r.keep for r in runs.frequent().collect()} == want


def test_few_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOTTEST", 1)
    assert found(spark.createDataFrame(PLANTED, "doc_id long, text string")) == brute(PLANTED)
