"""Every registered query against its SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from suite import MODULES
from suite.lab import GIVEN

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The training-text queries have tests of their own.
QUERIES = {name: build for module in MODULES for name, build in module.QUERIES.items()}
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = base.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert [str(got.schema.field(c).type) for c in sorted(got.column_names)] == [
        str(want.schema.field(c).type) for c in sorted(got.column_names)
    ]
    assert rows_of(got) == rows_of(want)
