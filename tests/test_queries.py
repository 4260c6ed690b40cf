"""Every query against its SQL at the smallest scale."""

import datetime
import decimal
import math

import duckdb
import pytest

from eventloom.plans import registry

Q, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_sql_is_of_registered_queries():
    assert not set(SQL) - set(Q)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = Q[name](spark, sf)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))  # what they give is held against numpy in test_models.py
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0
