"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from netlog.plans.queries import QUERIES as BATCH_QUERIES
from netlog.plans.streams import STREAM_QUERIES

QUERIES = {**BATCH_QUERIES, **STREAM_QUERIES}
SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = driver.queries()[name](spark, SF_DIR)
    want = oracle.sql(driver.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    types = {f.name: TYPES[f.dataType.simpleString()] for f in got.schema.fields}
    assert types == {c: str(t) for c, t in zip(want.columns, want.types)}
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)
    assert rows


def test_entry(spark):
    assert driver.entry(spark).count() == 3
