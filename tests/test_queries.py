"""Every registered query of the library against its DuckDB SQL, over whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tesserae.oracles import oracle_sql
from tesserae.queries import QUERIES

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)
    assert got


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_kmeans_codebook_has_every_code_once(spark, sf_dir):
    rows = QUERIES["kmeans_codebook"](spark, sf_dir).collect()
    assert sorted(r["code"] for r in rows) == list(range(8)) and len({(r["x"], r["y"], r["z"]) for r in rows}) == 8


def test_entry_module_lists_the_queries():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
