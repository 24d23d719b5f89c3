from __future__ import annotations

import json
import shutil

import pytest

from conftest import at, rows_of
from snapgrid.streaming.ingest import ingest_stream, late_rows
from test_sources import envelope, put, station


def run(spark, tmp_path, **options):
    query = ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options)
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("multiline", [None, True])
def test_runs_add_only_what_is_new(spark, tmp_path, multiline):
    first = put(tmp_path / "in/20240101T000000Z.json", envelope(station(1), station(2)), indent=1)
    put(tmp_path / "in/20240101T001500Z.json", envelope(station(1, 8)))
    assert run(spark, tmp_path, multiline=multiline, max_files=1).count() == 3
    assert run(spark, tmp_path, multiline=multiline).count() == 3
    # the same snapshot lands again in another folder
    (tmp_path / "in/again").mkdir()
    shutil.copy(first, tmp_path / "in/again/20240101T000000Z.json")
    put(tmp_path / "in/20240102T000000Z.json", envelope(station(2, 9)))
    out = run(spark, tmp_path, multiline=multiline)
    assert rows_of(out, "station_id", "fetched_at", "num_bikes_available") == [
        (1, at("2024-01-01 00:00:00"), 5), (1, at("2024-01-01 00:15:00"), 8),
        (2, at("2024-01-01 00:00:00"), 5), (2, at("2024-01-02 00:00:00"), 9)]
    assert sorted(p.name for p in (tmp_path / "out").glob("date=*")) == ["date=2024-01-01", "date=2024-01-02"]


def test_a_very_late_file_is_kept(spark, tmp_path):
    put(tmp_path / "in/20240301T000000Z.json", envelope(station(1)))
    run(spark, tmp_path)
    put(tmp_path / "in/20230101T000000Z.json", envelope(station(1)))
    assert run(spark, tmp_path).count() == 2
    (tmp_path / "in/again").mkdir()
    for name in ("20230101T000000Z.json", "20240301T000000Z.json"):  # one behind the watermark, one known to the state
        shutil.copy(tmp_path / "in" / name, tmp_path / "in/again" / name)
    assert run(spark, tmp_path).count() == 2
    assert [r["fetched_at"] for r in late_rows(spark, str(tmp_path / "out")).collect()] == [at("2023-01-01 00:00:00")] * 2


def test_the_state_alone_knows_recent_keys(spark, tmp_path):
    first = put(tmp_path / "in/20240101T000000Z.json", envelope(station(1), station(2)))
    run(spark, tmp_path)
    (tmp_path / "in/again").mkdir()
    put(tmp_path / "in/20240101T001500Z.json", envelope(station(1)))  # a batch of its own, compared with what is stored
    shutil.rmtree(tmp_path / "out")  # nothing left to compare with
    shutil.copy(first, tmp_path / "in/again/20240101T000000Z.json")
    out = run(spark, tmp_path, max_files=1)
    assert rows_of(out, "station_id", "fetched_at") == [(1, at("2024-01-01 00:15:00"))]
    assert late_rows(spark, str(tmp_path / "out")).count() == 0


def test_a_lost_checkpoint_is_made_up_for_in_every_batch(spark, tmp_path):
    for hour in range(3):
        put(tmp_path / f"in/20240101T0{hour}0000Z.json", envelope(station(1), station(2)))
    run(spark, tmp_path)
    query = ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "fresh"), max_files=1)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_repeats_within_and_across_batches(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", envelope(station(1), station(1), station(2)))
    put(tmp_path / "in/a/20240101T000000Z.json", envelope(station(2), station(3)))
    put(tmp_path / "in/b/20240105T000000Z.json", envelope(station(2), station(2)))
    assert run(spark, tmp_path, max_files=1).count() == 4


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", envelope(station(1), station(2)))
    run(spark, tmp_path)
    # a lost checkpoint offers every file again
    query = ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "fresh"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_files_of_both_kinds_keep_all_rows(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", "\n".join(" " + json.dumps(envelope(station(n), station(n + 1))) for n in (1, 3)))
    put(tmp_path / "in/20240101T001500Z.json", envelope(station(1)), indent=2)
    assert run(spark, tmp_path).count() == 5


def test_a_file_of_several_spanning_documents_keeps_all_rows(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", "\n".join(json.dumps(envelope(station(n)), indent=1) for n in (1, 2)))
    assert run(spark, tmp_path).count() == 2


def test_a_broken_file_fails(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", json.dumps(envelope(station(1)))[:-1])
    with pytest.raises(Exception, match="(?i)malformed"):
        run(spark, tmp_path)


def test_a_replay_without_station_adds_nothing(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", envelope(station(1), station(None)))
    assert run(spark, tmp_path).count() == 2
    query = ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "fresh"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
