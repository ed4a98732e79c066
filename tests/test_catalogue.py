"""Every query of the catalogue against its DuckDB form over the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_its_oracle(spark, duck, small_dir, name):
    found = catalogue.QUERIES[name](spark, small_dir)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(names)
    want = rows_of(names, cursor.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got, "a query without rows tests nothing"


def test_entry(spark, small_dir):
    assert {r["op"] for r in catalogue.entry(spark, small_dir).collect()} <= {"upsert", "delete"}


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
