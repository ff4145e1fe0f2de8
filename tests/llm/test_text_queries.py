"""Registered queries on the smallest tables: against their SQL where there is any, else their shape."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import rows_of
from ledgerloom.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_one_query_for_each_operator():
    known = entry.queries()
    assert [sum(name.startswith(f"op{n}_") for name in known) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in known and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, base, name):
    got = queries.QUERIES[name](spark, FOLDER).toArrow()
    want = base.sql(queries.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert [str(got.schema.field(c).type) for c in sorted(got.column_names)] == [
        str(want.schema.field(c).type) for c in sorted(got.column_names)
    ]
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, base, name):
    got = queries.QUERIES[name](spark, FOLDER)
    table = {"op10_language_id": "pages", "op13_whitening": "embeddings"}.get(name, "documents")
    rows = base.sql(f"SELECT count(*) FROM {table}").to_arrow_table().column(0)[0].as_py()
    assert got.count() >= rows


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
