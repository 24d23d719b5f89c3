"""Figures from the state kept per day against the exact operators, and sketches against both."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows_of, status_row
from snapgrid.functions.sketches import distinct_size, quantile_size
from snapgrid.operators import baseline, checks, consistency, coverage, daystate, freshness, timegrid


@pytest.fixture
def history(make_status):
    rows, start = [], dt.datetime(2024, 3, 30)
    for n in range(600):
        at = start + dt.timedelta(minutes=7 * n, seconds=n % 3)
        rows.append(status_row(n % 11 or None, at, None if n % 13 == 0 else n % 20, at - dt.timedelta(seconds=n * n % 100_000, microseconds=n),
                               docks=n % 9 - 1, mechanical=n % 7, renting=n % 5 > 0))
    rows += rows[::50] + [status_row(3, None, 4, "2024-03-30 10:00:00"), status_row(99, None, 1), status_row(98, "2024-03-31 02:30:00", None)]
    return make_status(rows)


@pytest.mark.parametrize("step", [15, 45])
def test_views_give_what_the_history_gives(history, step):
    state = daystate.day_state(history, step)
    runs, seen, buckets = daystate.runs_of(state), daystate.stations_of(state), daystate.buckets_of(state)
    same = [
        (coverage.volume_of(runs, seen, step), coverage.volume(history, step)), (coverage.cadence(runs, step), coverage.cadence(history, step)),
        (coverage.keys_per_day(seen), coverage.keys_per_day(history)), (coverage.keys_gone(seen), coverage.keys_gone(history)),
        (consistency.consistency_of(seen), consistency.consistency(history)),
        (freshness.freshness(history, counts=daystate.ages_of(state)), freshness.freshness(history)),
        (timegrid.fill_rate_of(buckets, runs, step), timegrid.fill_rate(history, step)),
        (baseline.target_pairs_of(buckets, runs, step, 60), baseline.target_pairs(history, step, 60)),
    ]
    for found, want in same:
        assert found.columns == want.columns and rows_of(found) == rows_of(want)


def test_a_new_day_is_added_to_what_is_stored(spark, history, tmp_path):
    dest, first = str(tmp_path / "state"), F.to_date("fetched_at") == F.lit("2024-03-30").cast("date")
    daystate.update_days(history.where(first), dest)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").glob("date=2024-03-30/*.parquet")}
    daystate.update_days(history, dest)
    daystate.update_days(history, dest)
    assert before and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "state").glob("date=2024-03-30/*.parquet")}
    columns = ["date", "kind", "fetched_at", "station_id", "places", "ts", "second", "n", "n_bikes", "last_seen"]
    assert rows_of(spark.read.parquet(dest), *columns) == rows_of(daystate.day_state(history), *columns)


def test_sketches_are_near(history):
    days = daystate.day_sketches(history, 0.01)
    exact = coverage.volume(history).first()
    for found in (daystate.volume_of_days(days).first(), coverage.volume(history, accuracy=0.01).first()):
        assert (found.n_lignes, found.debut, found.fin) == (exact.n_lignes, exact.debut, exact.fin)
        assert abs(found.n_runs - exact.n_runs) <= 0.04 * exact.n_runs and found.n_stations == exact.n_stations
    assert rows_of(daystate.keys_of_days(days)) == rows_of(coverage.keys_per_day(history)) == rows_of(coverage.keys_per_day(history, 0.01))
    exact = freshness.freshness(history).first()
    for found in (daystate.freshness_of_days(days).first(), freshness.freshness(history, accuracy=0.01).first()):
        assert (found.max_h, found.pct_sup_6h, found.pct_sup_24h) == (exact.max_h, exact.pct_sup_6h, exact.pct_sup_24h)
        assert found.p50_s == pytest.approx(exact.p50_s, rel=0.1) and found.p99_h == pytest.approx(exact.p99_h, rel=0.1)


def test_sketches_of_nothing(make_status):
    empty = make_status([])
    assert coverage.volume(empty, accuracy=0.05).first()["n_runs"] == 0
    assert freshness.freshness(empty, accuracy=0.05).first()["p50_s"] is None
    assert distinct_size(0.02) == 12 and quantile_size(0.01) > quantile_size(0.02) >= 8
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            distinct_size(bad)


def test_steps_are_counted_by_bits(spark):
    rows = [(1, n) for n in (0, 1, 1, 63, 64, 64, 127, 5000, None)] + [(2, None), (None, 7), (None, 7)]
    cells = spark.createDataFrame(rows, "station_id bigint, step bigint")
    assert rows_of(checks.held_steps(cells, F.col("step"))) == [(1, 6), (None, 1)]
