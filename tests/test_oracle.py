"""Every registered query against its SQL oracle."""

from __future__ import annotations

import datetime as dt

import pytest

import __spark_entry__ as driver
from conftest import SF_DIR
from snapgrid.plans.oracle import ORACLE
from snapgrid.plans.workload import QUERIES

ROWS_ONLY = {"discover_files"}

SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def test_only_file_and_preview_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, driver_tables, name):
    result = driver.queries()[name](spark, SF_DIR)
    names = sorted(result.columns)
    oracle = driver_tables.sql(driver.oracle_sql()[name])
    assert names == sorted(oracle.columns)
    types = dict(zip(oracle.columns, map(str, oracle.types)))
    assert {f.name: SPARK_TO_SQL[f.dataType.simpleString()] for f in result.schema.fields} == types
    order = [oracle.columns.index(n) for n in names]
    expected = ordered(tuple(row[i] for i in order) for row in oracle.fetchall())
    assert ordered(map(tuple, result.select(names).collect())) == expected


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_query_has_rows(spark, name):
    assert driver.queries()[name](spark, SF_DIR).count() > 0


def test_entry_has_the_slots_of_the_smoke_tables(spark):
    assert [row["creneau"] for row in driver.entry(spark).collect()] == sorted(
        row["creneau"] for row in driver.entry(spark).collect())


def test_no_query_depends_on_the_session_zone(spark, driver_tables):
    from snapgrid.operators import baseline, coverage
    from snapgrid.plans import standin
    status = standin.status(spark, SF_DIR)
    expected = [tuple(r) for r in baseline.target_pairs(status).orderBy("station_id", "ts").collect()]
    days = [tuple(r) for r in coverage.cadence(status).collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        status = standin.status(spark, SF_DIR)
        assert [tuple(r) for r in baseline.target_pairs(status).orderBy("station_id", "ts").collect()] == expected
        assert [tuple(r) for r in coverage.cadence(status).collect()] == days
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert isinstance(expected[0][1], dt.datetime)
