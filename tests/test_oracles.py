"""Every query of the library against its SQL twin."""

import os

import duckdb
import pytest

from tessera.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    theirs = sorted((tuple(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()), key=repr)
    assert mine == theirs
