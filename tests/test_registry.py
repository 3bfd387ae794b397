"""Every registered query against its SQL on the smallest data, when the data is there."""

import os

import duckdb
import pytest

import check
from registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    report = check.compare(spark, con, name, SF_DIR)
    assert ": ok" in report or ": rows only" in report, report


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
