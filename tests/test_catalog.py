"""Every query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

from foliant.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    if name in catalog.ORACLE_SQL:
        expected = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(expected.columns)
        assert comparable(rows, found.columns) == comparable(expected.fetchall(), expected.columns)
