from __future__ import annotations

import datetime as dt
import pathlib
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from snapgrid.session import configure  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def driver_tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


STATUS_DDL = ("station_id bigint, fetched_at timestamp_ntz, last_reported timestamp_ntz, num_bikes_available int, "
              "num_docks_available int, mechanical int, ebike int, is_renting boolean, is_installed boolean")


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def status_row(station, fetched, bikes, reported=None, docks=0, mechanical=0, ebike=0, renting=True, installed=True):
    fetched = at(fetched) if isinstance(fetched, str) else fetched
    reported = at(reported) if isinstance(reported, str) else reported
    return (station, fetched, reported, bikes, docks, mechanical, ebike, renting, installed)


@pytest.fixture
def make_status(spark):
    def make(rows):
        return spark.createDataFrame(rows, STATUS_DDL)
    return make


def rows_of(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()),
                  key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture
def sql_on():
    """Rows of a SQL query over a small status DataFrame."""
    def run(status, sql, **more):
        con = duckdb.connect()
        con.register("status", status.toArrow())
        for name, df in more.items():
            con.register(name, df.toArrow())
        return sorted(con.execute(sql).fetchall(), key=lambda r: tuple((v is None, str(v)) for v in r))
    return run
