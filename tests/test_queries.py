import math
import os

import duckdb
import pytest

from veilscribe import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def values(rows):
    def plain(x):
        return round(float(x), 5) + 0.0 if type(x).__name__ in ("float", "Decimal") and math.isfinite(x) else x

    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = values(tuple(r) for r in found.select(*columns).collect())
    if name in catalogue.SQL:
        expected = tables.sql(catalogue.SQL[name])
        assert sorted(expected.columns) == columns
        assert rows == values(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert rows
