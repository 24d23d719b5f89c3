"""A grid that grows by appends against one that is made at once."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows_of, status_row
from snapgrid.operators import baseline, gridstore, timegrid
from snapgrid.operators.gridstore import BehindTheGrid, GridStore


@pytest.fixture
def history(make_status):
    start = dt.datetime(2024, 1, 1, 5, 20)
    rows = [status_row(n % 5 if n < 300 else n % 9, start + dt.timedelta(minutes=11 * n), None if n % 17 == 0 else n % 20) for n in range(500)]
    return make_status(rows + [status_row(None, "2024-01-02 08:00:00", 3), status_row(77, "2024-01-04 00:00:00", None)])


def test_appended_days_are_the_whole_grid(spark, history):
    store = GridStore(spark, f"g_{uuid.uuid4().hex}", buckets=2)
    for day in sorted(r[0] for r in history.select(F.to_date("fetched_at")).distinct().collect()):
        store.append(history.where(F.to_date("fetched_at") == F.lit(day)))
    assert rows_of(store.cells()) == rows_of(timegrid.grid(history))
    assert rows_of(store.target()) == rows_of(baseline.target(history))
    with pytest.raises(BehindTheGrid):
        store.append(history.where("station_id = 1"))


def test_the_target_needs_no_exchange(spark, history):
    store = GridStore(spark, f"g_{uuid.uuid4().hex}", buckets=2)
    store.append(history)
    plan = store.target()._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "Bucketed: true" in plan


def test_buckets_follow_the_stations(spark, history, monkeypatch):
    monkeypatch.setattr(gridstore, "STATIONS", 2)
    store = GridStore(spark, f"g_{uuid.uuid4().hex}", buckets=2)
    cut = F.lit("2024-01-03").cast("timestamp_ntz")
    store.append(history.where(F.col("fetched_at") < cut))
    made = store.n_buckets(0)
    store.append(history.where(F.col("fetched_at") >= cut))  # goes to the buckets that are there
    assert made > 2 and store.n_buckets(10**9) == made
    assert rows_of(store.cells()) == rows_of(timegrid.grid(history))
    assert rows_of(store.target()) == rows_of(baseline.target(history))
    plan = store.target()._jdf.queryExecution().executedPlan().toString()
    assert f"{made} out of {made}" in plan and "Exchange" not in plan


def test_what_has_no_grid_is_refused(spark, make_status, history):
    with pytest.raises(ValueError):
        GridStore(spark, "never", 25).append(history)
    with pytest.raises(ValueError):
        GridStore(spark, "never").append(make_status([]))
