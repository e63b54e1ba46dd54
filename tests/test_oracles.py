"""Each query's rows are those that its SQL gives on the same tables."""

import hashlib

import duckdb
import pytest

from tessera.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(hashlib.md5("|".join(cell(r[k]) for k in order).encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    want = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, got) == canonical(want.columns, want.fetchall())
