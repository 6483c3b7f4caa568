"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from opsbook.plans import queries as books

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return f"{round(float(v), 4) + 0.0:.4f}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(books.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = books.QUERIES[name](spark, sf_dir)
    want = duck.execute(books.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = got.select(*(f"`{c}`" for c in columns)).collect()
    numeric = {c for c, k in got.dtypes if k in ("double", "float") or k.startswith("decimal")}

    def row(r):
        return tuple(plain(float(v)) if c in numeric and v is not None else plain(v) for c, v in zip(columns, r))

    assert sorted(map(row, rows)) == sorted(map(row, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
