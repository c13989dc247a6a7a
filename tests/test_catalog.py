"""Every registered query beside its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return [columns[i] for i in order], sorted(repr([clean(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    cursor = db.execute(SQL[name])
    assert cells(df.columns, rows) == cells([d[0] for d in cursor.description], cursor.fetchall())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
