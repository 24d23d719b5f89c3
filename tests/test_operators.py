from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import at, rows_of, status_row
from snapgrid.operators import baseline, checks, coverage, profile, timegrid
from snapgrid.operators.consistency import consistency
from snapgrid.operators.freshness import freshness
from snapgrid.operators.islands import frozen, frozen_agreement, islands
from snapgrid.operators.latest import latest_per_bucket, latest_per_key
from snapgrid.plans import oracle
from snapgrid.schema import canonicalise

SECONDS = dt.timedelta(seconds=1)


def random_history(seed, n=300, stations=5, span_h=40, values=3, null_rate=0.1, hot=True, distinct=True):
    """Rows of a few stations; station 0 holds at least a third of them."""
    rng = random.Random(seed)
    seen, rows = set(), []
    for _ in range(n):
        station = 0 if hot and rng.random() < 0.34 else rng.randrange(stations)
        moment = at("2024-03-30 05:20:00") + rng.randrange(span_h * 3600) * SECONDS
        if distinct and (station, moment) in seen:
            continue
        seen.add((station, moment))
        bikes = None if rng.random() < null_rate else rng.randrange(values)
        reported = None if rng.random() < 0.1 else moment - rng.randrange(-60, 40_000) * SECONDS
        rows.append(status_row(station, moment, bikes, reported))
    return rows


# -- latest ---------------------------------------------------------------

def test_latest_per_key_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 9), (2, None, 1)], "k int, fetched_at int, tie int")
    assert rows_of(latest_per_key(df, ["k"], ties=["tie"])) == [(1, 5, 2), (2, None, 1)]


def test_latest_in_bucket_may_be_null_and_tie_break_takes_the_greatest(make_status):
    status = make_status([
        status_row(1, "2024-01-01 00:01:00", 7), status_row(1, "2024-01-01 00:14:00", None),
        status_row(2, "2024-01-01 00:05:00", 3), status_row(2, "2024-01-01 00:05:00", 8)])
    assert rows_of(latest_per_bucket(status, tie_break=True), "station_id", "n_bikes") == [(1, None), (2, 8)]
    assert rows_of(latest_per_bucket(status).where("station_id = 1"), "n_bikes") == [(None,)]


# -- coverage ---------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_cadence_equals_one_global_lag(make_status, sql_on, seed):
    rng = random.Random(seed)
    # bursts inside one minute, sparse minutes and empty days
    rows = [status_row(1, at("2024-01-01") + dt.timedelta(days=rng.choice([0, 0, 1, 5, 9]),
                       minutes=rng.choice([0, 1, 700, rng.randrange(1440)]), microseconds=rng.randrange(59_000_000)), 1)
            for _ in range(200)]
    status = make_status(rows + rows[:40])
    sql = "WITH " + oracle._cadence("status") + "SELECT * FROM cadence"
    assert rows_of(coverage.cadence(status)) == sql_on(status, sql)


def test_cadence_of_a_single_run(make_status):
    status = make_status([status_row(1, "2024-01-01 10:00:00", 1), status_row(2, "2024-01-01 10:00:00", 1)])
    assert rows_of(coverage.cadence(status)) == [(dt.date(2024, 1, 1), 1, None, None, 0)]


def test_volume_of_one_instant_and_of_nothing(make_status):
    one = coverage.volume(make_status([status_row(1, "2024-01-01 10:00:00", 1)])).first()
    assert (one.n_lignes, one.n_runs, one.jours, one.taux_collecte) == (1, 1, 0.0, 0.0)
    none = coverage.volume(make_status([])).first()
    assert (none.n_lignes, none.n_runs, none.n_stations, none.taux_collecte) == (0, 0, 0, None)


def test_station_gone_needs_strictly_more_than_the_limit(make_status):
    status = make_status([status_row(1, "2024-01-01 00:00:00", 1), status_row(2, "2024-01-01 12:00:00", 1),
                          status_row(3, "2023-12-31 23:59:59", 1)])
    assert coverage.keys_gone(status).first()["n_absentes"] == 1


# -- freshness and consistency -----------------------------------------------

def test_freshness_keeps_negative_and_drops_null(make_status, sql_on):
    status = make_status(random_history(5, n=400))
    sql = "WITH " + oracle.FRESHNESS + " SELECT * FROM freshness"
    assert rows_of(freshness(status)) == sql_on(status, sql)


def test_a_step_beyond_the_horizon_is_refused(make_status):
    with pytest.raises(ValueError):
        baseline.target_pairs(make_status(random_history(6, n=20)), step_min=90)


def test_consistency_with_and_without_reference(spark, make_status):
    status = make_status([
        status_row(1, "2024-01-01 00:00:00", 5, docks=6, mechanical=5, ebike=0),
        status_row(1, "2024-01-01 01:00:00", None, docks=6),
        status_row(2, "2024-01-01 00:00:00", -1, docks=30, mechanical=1, renting=False),
        status_row(3, "2024-01-01 00:00:00", 5, docks=600, mechanical=5, installed=False, renting=None)])
    info = spark.createDataFrame([(1, 10, at("2024-01-02")), (1, 99, at("2024-01-01")), (2, None, at("2024-01-01"))],
                                 "station_id bigint, capacity int, fetched_at timestamp_ntz")
    assert rows_of(consistency(status, info)) == [(4, 1, 1, 1, 1, 1, 1)]
    assert rows_of(consistency(status)) == [(4, 1, 1, 1, None, 1, 1)]


# -- islands ---------------------------------------------------------------

@pytest.mark.parametrize("slice_min", [10, 180, 60_000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_equal_one_window_per_station(make_status, sql_on, seed, slice_min):
    status = make_status(random_history(seed, values=2, span_h=30))
    sql = "WITH " + oracle.ISLANDS + "SELECT station_id, valeur, n_obs, debut, fin FROM islands"
    got = rows_of(islands(status, slice_min=slice_min), "station_id", "valeur", "n_obs", "debut", "fin")
    assert got == sql_on(status, sql)
    assert rows_of(islands(status, slice_min=slice_min, unique=True), "station_id", "valeur", "n_obs", "debut",
                   "fin") == got
    assert sum(r[2] for r in got) == status.where("num_bikes_available IS NOT NULL").count()


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_islands_with_several_values_at_one_instant(make_status, sql_on, seed):
    rng = random.Random(seed)
    rows = [status_row(rng.randrange(2), at("2024-01-01 00:30:00") + dt.timedelta(minutes=20 * rng.randrange(12)),
                       rng.randrange(2)) for _ in range(40)]
    status = make_status(rows)
    # values of one instant are ordered by value, and share an island
    sql = "WITH " + oracle.ISLANDS
    got = rows_of(islands(status), "station_id", "valeur", "n_obs", "debut", "fin")
    assert got == sql_on(status, sql + "SELECT station_id, valeur, n_obs, debut, fin FROM islands")


def test_null_value_is_bridged_and_single_observation_has_no_length(make_status):
    status = make_status([status_row(1, "2024-01-01 00:00:00", 5), status_row(1, "2024-01-01 04:00:00", None),
                          status_row(1, "2024-01-01 08:00:00", 5), status_row(1, "2024-01-01 09:00:00", 6)])
    assert rows_of(islands(status), "valeur", "n_obs", "duree_h") == [(5, 2, 8.0), (6, 1, 0.0)]


@pytest.mark.parametrize("slice_min", [1, 180, 3000])
def test_frozen_equals_its_definition_and_is_cumulative(make_status, sql_on, slice_min):
    status = make_status(random_history(11, n=250, values=1, span_h=60, null_rate=0.3)
                         + random_history(12, n=60, values=2, span_h=200))
    status = status.dropDuplicates(["station_id", "fetched_at"])
    status = status.persist()
    got = rows_of(frozen(status, slice_min=slice_min))
    assert got == sql_on(status, "WITH " + oracle.ISLANDS + "SELECT * FROM frozen")
    counts = [r[1] for r in sorted(got)]
    assert counts == sorted(counts, reverse=True)
    status.unpersist()


def test_threshold_without_island_gives_no_row(make_status):
    status = make_status([status_row(1, f"2024-01-01 0{h}:00:00", h) for h in range(5)])
    assert rows_of(frozen(status)) == []
    assert rows_of(frozen_agreement(frozen(status))) == []


# -- grid and target ---------------------------------------------------------

@pytest.mark.parametrize("step", [15, 20, 25, 45, 60, 90, 120])
@pytest.mark.parametrize("seed", [1, 2])
def test_grid_equals_the_scaffold_join(make_status, sql_on, seed, step):
    status = make_status(random_history(seed, n=120)).persist()
    sql = "WITH " + oracle._grid(step)
    assert rows_of(timegrid.grid(status, step)) == sql_on(status, sql + "SELECT * FROM grid")
    assert rows_of(timegrid.fill_rate(status, step)) == sql_on(status, sql + "," + oracle.FILL + "SELECT * FROM fill")
    if step > 60:
        with pytest.raises(ValueError, match="horizon"):
            baseline.target(status, step)
        return
    columns = "station_id, ts, n_bikes, is_imputed, y, y_imputed, h_paris"
    cells = baseline.target(status, step)
    assert rows_of(cells) == sql_on(status, sql + f"SELECT {columns} FROM target")
    pairs = sql_on(status, sql + f"SELECT {columns} FROM pairs")
    assert rows_of(baseline.observed_pairs(cells)) == pairs
    assert rows_of(baseline.target_pairs(status, step)) == pairs
    status.unpersist()


def test_late_station_gets_the_full_range(make_status):
    status = make_status([status_row(1, "2024-01-01 00:20:00", 5), status_row(2, "2024-01-01 02:50:00", 6)])
    cells = timegrid.grid(status, 15)
    assert cells.groupBy("station_id").count().select("count").distinct().collect()[0][0] == 12
    assert rows_of(cells.where("NOT is_imputed"), "station_id", "ts", "n_bikes") == [
        (1, at("2024-01-01 00:15:00"), 5), (2, at("2024-01-01 02:45:00"), 6)]


def test_grid_size_is_stations_times_steps(make_status):
    status = make_status(random_history(9))
    n_steps = timegrid.grid_bounds(status, 15).first()["n_steps"]
    stations = status.select("station_id").distinct().count()
    assert timegrid.grid(status, 15).count() == n_steps * stations
    assert timegrid.fill_rate(status, 15).first()["cases"] == n_steps * stations


def test_worst_holes_breaks_ties_by_station(make_status):
    status = make_status([status_row(s, f"2024-01-01 00:{m:02d}:00", 1) for s in (5, 3, 9) for m in (0, 30)]
                         + [status_row(1, "2024-01-01 00:00:00", None)])
    assert rows_of(timegrid.worst_holes(status, 15, k=2)) == [(1, 100.0), (3, 33.3)]


def test_empty_history_gives_empty_grid(make_status):
    status = make_status([])
    assert timegrid.grid(status).count() == 0
    assert rows_of(timegrid.fill_rate(status)) == [(0, None)]
    assert baseline.persistence_mae(baseline.target_pairs(status)).first()["mae"] is None


def test_slots_cover_every_hour(spark):
    hours = spark.range(24).select(baseline.slot(F.col("id")).alias("s")).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in hours} == {
        "00-06 nuit": 6, "06-10 pointe matin": 4, "10-16 journée": 6, "16-20 pointe soir": 4, "20-24 soirée": 4}


# -- checks and profile -------------------------------------------------------

def test_dq_checks_find_what_is_wrong_in_the_given_tables(make_status):
    status = make_status([status_row(1, "2024-01-01 00:00:00", 5), status_row(1, "2024-01-01 00:00:00", 5),
                          status_row(1, "2024-01-01 03:00:00", 500), status_row(2, "2024-01-01 03:00:00", None)])
    grid, target = timegrid.grid(status), baseline.target(status)
    found = dict(rows_of(checks.dq_checks(status, grid, target)))
    assert found == {"duplicate_key": 1, "value_range": 1, "grid_hole": 0, "late_target": 0}
    # a repeated cell and a foreign one do not stand in for a lost one, and a lost station lacks all 13 cells
    lost = grid.where("station_id = 1 AND hour(ts) <> 1")
    torn = lost.unionByName(lost).unionByName(lost.withColumn("ts", F.expr("ts + INTERVAL 1 DAY")))
    filled = target.withColumn("y", F.lit(3))
    found = dict(rows_of(checks.dq_checks(status, torn, filled)))
    assert found == {"duplicate_key": 1, "value_range": 1, "grid_hole": 4 + 13, "late_target": 2 * 4}


def test_null_times_and_stations_keep_the_grid_whole(make_status):
    status = make_status([status_row(1, "2024-01-01 00:00:00", 4), status_row(1, "2024-01-01 00:30:00", 5),
                          status_row(2, None, 6), status_row(2, None, 7), status_row(None, "2024-01-01 00:15:00", 8)])
    cells = timegrid.grid(status)
    assert cells.count() == 9 and cells.where("NOT is_imputed").count() == 2
    assert rows_of(timegrid.fill_rate(status)) == [(9, 22.22)]
    assert rows_of(timegrid.worst_holes(status)) == [(1, 33.3), (2, 100.0), (None, 100.0)]
    assert baseline.target(status).count() == 9
    assert [r[1] for r in rows_of(coverage.cadence(status))] == [3, 1]


def test_text_times_with_an_offset_become_utc(spark):
    texts = ["2024-07-01T10:00:00+02:00", "2024-07-01 10:00:00Z", "2024-07-01 10:00:00.5", "2024-07-01", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "station_id bigint, fetched_at string")
    got = [r.fetched_at for r in canonicalise(df).orderBy("station_id").collect()]
    assert got == [at("2024-07-01 08:00:00"), at("2024-07-01 10:00:00"), at("2024-07-01 10:00:00.5"), at("2024-07-01"), None]


def test_conformance_names_what_is_missing(spark):
    df = spark.createDataFrame([(1, [(1,)])], "station_id bigint, num_bikes_available_types array<struct<ebike:int>>")
    found = {(r["check"], r["column"]): r.ok for r in profile.conformance(df).collect()}
    assert found["required", "station_id"] and not found["required", "fetched_at"]
    assert found["nested", "num_bikes_available_types"] is False
    assert found["time_axis", "fetched_at"] is False and found["usable", None] is False
    assert not profile.conforms(df)


def test_bounds_leave_out_absent_columns(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "station_id bigint")
    assert profile.bounds(df).first().asDict() == {"n_lignes": 3, "n_stations": 2}


def test_preview_is_cut(spark):
    df = spark.createDataFrame([("x" * 50, [1, 2])] * 5, "a string, b array<int>")
    rows = profile.preview(df).collect()
    assert len(rows) == 3 and rows[0].a == "x" * 34 and rows[0].b == "[1, 2]"


def test_nested_values_as_text(spark):
    kind = "s struct<`a b`:int,c:string,d:array<struct<e:double,f:boolean>>>, m map<string,date>, n array<int>, z string"
    rows = [((1, "plain x", [(1.5, True), None, (None, False)]), {"k": None}, [], "it's"), ((None, "it's, \\ x", None), None, None, None),
            (None, {}, [None, 2], ""), ((2, "", []), {"a=b": dt.date(2024, 1, 2)}, [3], "{x}"), ((3, "NULL", []), {" k": None}, [4], " ")]
    found = [tuple(r) for r in profile.preview(spark.createDataFrame(rows, kind), 9, 1000).collect()]
    assert found == [
        ("{'a b': 1, 'c': plain x, 'd': [{'e': 1.5, 'f': true}, NULL, {'e': NULL, 'f': false}]}", "{k=NULL}", "[]", "it's"),
        ("{'a b': NULL, 'c': 'it\\'s, \\\\ x', 'd': NULL}", None, None, None), (None, "{}", "[NULL, 2]", ""),
        ("{'a b': 2, 'c': '', 'd': []}", "{'a=b'=2024-01-02}", "[3]", "{x}"), ("{'a b': 3, 'c': 'NULL', 'd': []}", "{' k'=NULL}", "[4]", " ")]


def test_bounds_by_what_is_there(spark, make_status):
    status = make_status([status_row(1, "2024-01-01 10:00:00", 5), status_row(1, "2024-01-01 10:00:00", 5), status_row(None, None, 5)])
    assert profile.bounds(status).first().asDict() == {"n_lignes": 3, "debut": at("2024-01-01 10:00:00"), "fin": at("2024-01-01 10:00:00"),
                                                       "n_runs": 1, "n_stations": 1}
    assert profile.bounds(status.select("station_id")).first().asDict() == {"n_lignes": 3, "n_stations": 1}
    assert profile.bounds(status.select("fetched_at")).first()["n_runs"] == 1
    assert profile.bounds(status.select("ebike")).first().asDict() == {"n_lignes": 3}
    assert profile.bounds(status.limit(0)).first().asDict() == {"n_lignes": 0, "debut": None, "fin": None, "n_runs": 0, "n_stations": 0}
