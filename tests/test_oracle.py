"""Every registered query against its SQL twin in another engine."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from awardlens import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def in_order(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, oracle, name):
    result = oracle.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert in_order(df.collect(), df.columns) == in_order(result.fetchall(), names)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
