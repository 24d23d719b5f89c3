from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import at
from snapgrid.functions.feed import stamp_of, type_count
from snapgrid.functions.numbers import percent, round_to
from snapgrid.functions.quantiles import exact_quantiles, upper_second
from snapgrid.functions.time import bucket, from_micros, minute_number, local_hour, micros
from snapgrid.session import scratch_dir

TIMES = ["1969-12-31 23:59:59.999999", "1999-12-31 23:50:00", "2000-01-03 00:00:00", "2024-01-01 00:00:00.000001",
         "2024-03-10 02:30:00", "2024-03-31 01:30:00", "2024-10-27 00:59:59.5", "2024-10-27 01:10:00"]


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_micros_round_trip_in_any_session_zone(spark, zone):
    df = spark.createDataFrame([(at(t),) for t in TIMES], "ts timestamp_ntz")
    rows = df.select("ts", micros("ts").alias("us"), from_micros(micros("ts")).alias("back"),
                     minute_number("ts").alias("m")).collect()
    for row in rows:
        expected = (row.ts - at("1970-01-01")).total_seconds()
        assert row.back == row.ts
        assert row.us == round(expected * 1e6)
        assert row.m == expected // 60


@pytest.mark.parametrize("step", [5, 15, 25, 45, 60, 120])
def test_bucket_counts_from_the_fixed_monday(spark, zone, step):
    import duckdb
    df = spark.createDataFrame([(at(t),) for t in TIMES], "ts timestamp_ntz")
    got = [r.b for r in df.select(bucket("ts", step).alias("b")).collect()]
    want = [duckdb.execute(f"SELECT time_bucket(INTERVAL {step} MINUTE, TIMESTAMP '{t}')").fetchone()[0] for t in TIMES]
    assert got == want


def test_local_hour_follows_daylight_saving(spark, zone):
    cases = [("2024-03-31 00:59:00", 1), ("2024-03-31 01:00:00", 3), ("2024-10-27 00:30:00", 2),
             ("2024-10-27 01:30:00", 2), ("2024-10-27 02:30:00", 3), ("2024-07-01 23:00:00", 1)]
    df = spark.createDataFrame([(at(t), h) for t, h in cases], "ts timestamp_ntz, want int")
    for row in df.select("*", local_hour(micros("ts")).alias("got")).collect():
        assert row.got == row.want, row


def test_local_hour_with_a_fixed_offset(spark):
    df = spark.createDataFrame([(at("2024-01-01 23:10:00"),)], "ts timestamp_ntz")
    assert df.select(local_hour(micros("ts"), "fixed+2")).first()[0] == 1


def test_rounding_uses_the_binary_value(spark):
    row = spark.range(1).select(
        round_to(F.lit(1.005), 2).alias("a"), round_to(F.lit(2.5)).alias("b"), round_to(F.lit(-2.5)).alias("c"),
        percent(F.lit(1), F.lit(0), 2).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (1.0, 3.0, -3.0, None)


def test_type_list_rules(spark):
    ddl = "id int, types array<struct<mechanical:int,ebike:int>>"
    df = spark.createDataFrame([
        (1, [(3, None), (None, 1)]), (2, [(3, None), (5, None)]), (3, []), (4, None), (5, [(0, None)])], ddl)
    first = [(r[0], r[1]) for r in df.select(type_count("types", "mechanical"), type_count("types", "ebike")).collect()]
    last = [(r[0], r[1]) for r in df.select(type_count("types", "mechanical", "last", None),
                                            type_count("types", "ebike", "last", None)).collect()]
    assert first == [(3, 1), (3, 0), (0, 0), (0, 0), (0, 0)]
    assert last == [(3, 1), (5, None), (None, None), (None, None), (0, None)]


def test_stamp_strict_and_lenient(spark):
    df = spark.createDataFrame([("s3a://b/raw/20240102T030405Z.json",), ("raw/nothing.json",)], "filename string")
    assert [r[0] for r in df.select(stamp_of("filename", strict=False)).collect()] == [at("2024-01-02 03:04:05"), None]
    with pytest.raises(Exception, match="no collection stamp"):
        df.select(stamp_of("filename")).collect()


def quantiles(spark, values, qs):
    """Quantiles of intervals given in microseconds, in microseconds."""
    df = spark.createDataFrame([(int(v),) for v in values], "x bigint")
    interval = F.expr("INTERVAL '0.000001' SECOND * x")
    return [q * 1e6 for q in exact_quantiles(df, interval, qs).first()["q"]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3_000_000, 3_000_000), st.integers(-10**12, 10**12)),
                min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    qs = [0.0, 0.5, 0.9, 0.99, 1.0]
    assert quantiles(spark, values, qs) == pytest.approx(list(np.quantile(values, qs)), rel=1e-9, abs=1e-3)


def test_quantiles_with_one_value_on_most_rows(spark):
    rng = random.Random(3)
    values = [777] * 2000 + [rng.randint(-10**11, 10**11) for _ in range(1000)]
    qs = [0.01, 0.33, 0.5, 0.8, 0.999]
    assert quantiles(spark, values, qs) == pytest.approx(list(np.quantile(values, qs)), rel=1e-9, abs=1e-3)


def test_quantiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,)], "x interval day to second")
    assert exact_quantiles(df, F.col("x"), [0.5]).first()["q"] == [None]


def test_upper_second_decides_whole_second_limits(spark):
    df = spark.createDataFrame([(us,) for us in (-2_500_000, -1, 0, 1, 999_999, 10**6, 10**6 + 1)], "x bigint")
    got = [r[0] for r in df.select(upper_second(F.expr("INTERVAL '0.000001' SECOND * x"))).collect()]
    assert got == sorted(got)
    assert [g > 0 for g in got] == [False, False, False, True, True, True, True]
    assert [g > 1 for g in got] == [False] * 6 + [True]


def test_scratch_data_needs_a_shared_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({key.replace("_", "."): value for key, value in conf.items()})

    assert scratch_dir(Session(spark_checkpoint_dir="hdfs://x/c/", spark_master="yarn"), "a").startswith("hdfs://x/c/a-")
    shared = Session(**{"spark_sql_warehouse_dir": "s3a://x/w", "spark_master": "yarn"})
    assert scratch_dir(shared, "a").startswith("s3a://x/w/scratch/a-") and scratch_dir(shared, "a") != scratch_dir(shared, "a")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch_dir(Session(spark_sql_warehouse_dir="file:/tmp/w", spark_master=master), "a")
