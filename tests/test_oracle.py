"""Every registered query of the engine proper against its SQL in DuckDB, row by row."""

import decimal

import duckdb
import pytest

from quillmesh.plans import composites, relational, retrieval, scans, services, spatial  # noqa: F401
from quillmesh.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v


def rows(found):
    return sorted([tuple(plain(v) for v in r) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    if name in ORACLE_SQL:
        expected = duck.sql(ORACLE_SQL[name])
        assert sorted(expected.columns) == columns
        assert got == rows(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    else:
        assert got
