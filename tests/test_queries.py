"""Every registered reasoning query against its SQL, on the smallest tables."""
import os

import duckdb
import pytest

from taxoflux import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = queries.QUERIES[name](spark, DATA)
    want = db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert values(got.select(*columns).collect()) == values(want.select(*columns).fetchall())
