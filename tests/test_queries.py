"""Every query that needs no corpus against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewright import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("customer", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", list(plans.oracles()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, SF)
    sql = db.sql(plans.oracles()[name])
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(sql.columns, sql.fetchall())
    assert sorted(df.columns) == sorted(sql.columns)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b, strict=True)), (a, b)
