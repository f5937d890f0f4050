"""Every registered query against its SQL oracle on the smallest data set."""

from __future__ import annotations

import os

import pytest
from compare import duck_table, spark_table

from __spark_entry__ import entry, oracle_sql, queries
from lacuna.plans.oracles import ORACLES
from lacuna.plans.queries import QUERIES, TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    assert spark_table(QUERIES[name](spark, FOLDER)) == duck_table(duck, ORACLES[name])


def test_entry(spark):
    assert entry(spark).count() > 0
