from __future__ import annotations

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import at, rows_of
from snapgrid.operators.envelope import flat_status, flatten_envelope, landed_rows
from snapgrid.schema import ENVELOPE, INFO, LANDED_RENAMES, STATUS, canonicalise
from snapgrid.sources.convert import EmptyFeed, convert, convert_first
from snapgrid.sources.discover import discover
from snapgrid.sources.documents import documents
from snapgrid.sources.drift import wider
from snapgrid.plans.audit import run_audit
from snapgrid.plans.inspection import inspect_tree
from snapgrid.sources.landing import land, landed, publish, stage
from snapgrid.sources.readers import (UnsupportedFormat, between_dates,
                                       read_snapshots)
from snapgrid.session import located
from snapgrid.sources.sinks import write_report


def station(sid, bikes=5, types=None, **more):
    return {"station_id": sid, "stationCode": str(sid), "num_bikes_available": bikes, "num_docks_available": 2,
            "num_bikes_available_types": [{"mechanical": 3}, {"ebike": 2}] if types is None else types,
            "is_installed": 1, "is_renting": 0, "is_returning": 1, "last_reported": 1704067200, **more}


def put(path: pathlib.Path, payload, indent=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload, indent=indent))
    return str(path)


def envelope(*stations, **more):
    return {"last_updated": 1704067260, "data": {"stations": list(stations)}, **more}


# -- discovery and dispatch ----------------------------------------------------

def test_discover_groups_by_dataset_and_extension(spark, tmp_path):
    put(tmp_path / "raw/status/date=2024-01-01/a.json", "{}")
    put(tmp_path / "raw/status/date=2024-01-02/b.json", "{ }")
    put(tmp_path / "raw/status/date=2024-01-02/c.csv", "x")
    put(tmp_path / "raw/information/i.ndjson", "{}")
    put(tmp_path / "top.gz", "abc")
    put(tmp_path / "notes.txt", "left out")
    assert rows_of(discover(spark, str(tmp_path))) == [
        (".", ".gz", 1, 3), ("raw/information", ".ndjson", 1, 2),
        ("raw/status", ".csv", 1, 1), ("raw/status", ".json", 2, 5)]
    assert rows_of(discover(spark, str(tmp_path / "raw/status"))) == [(".", ".csv", 1, 1), (".", ".json", 2, 5)]
    assert rows_of(discover(spark, str(tmp_path / "top.gz"))) == [(".", ".gz", 1, 3)]


def test_unknown_extension_is_refused(spark, tmp_path):
    with pytest.raises(UnsupportedFormat):
        read_snapshots(spark, str(tmp_path / "x.avro"))


@pytest.mark.parametrize("ext,fmt", [(".csv", "csv"), (".ndjson", "json"), (".gz", "json"), (".parquet", "parquet")])
def test_formats_round_trip(spark, tmp_path, ext, fmt):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "k bigint, v double, t string")
    writer = df.write.option("header", True)
    (writer.option("compression", "gzip") if ext == ".gz" else writer).format(fmt).save(str(tmp_path / "d"))
    schema = None if ext != ".csv" else df.schema
    got = read_snapshots(spark, str(tmp_path / "d"), ext, schema=schema).select("k", "v", "t")
    assert rows_of(got) == rows_of(df)


def test_recursive_glob_with_and_without_date_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, date string")
    df.write.partitionBy("date").parquet(str(tmp_path / "s"))
    hive = read_snapshots(spark, f"{tmp_path}/s/**/*.parquet", start="2024-01-02")
    assert hive.schema["date"].dataType.simpleString() == "date" and [r.k for r in hive.collect()] == [2]
    df.where("k = 1").drop("date").write.parquet(str(tmp_path / "deep/a/date=2024-01-01"))
    df.where("k = 2").drop("date").write.parquet(str(tmp_path / "deep/b/date=2024-01-02"))
    deep = read_snapshots(spark, f"{tmp_path}/deep/**/*.parquet")
    assert sorted(r.k for r in deep.collect()) == [1, 2]
    assert [r.k for r in read_snapshots(spark, f"{tmp_path}/deep/**/*.parquet", end="2024-01-01").collect()] == [1]


def test_date_bounds_prune_folders(spark, tmp_path):
    spark.range(10).withColumn("date", F.expr("date'2024-01-01' + CAST(id AS INT)")).write.partitionBy("date").parquet(
        str(tmp_path / "s"))
    df = read_snapshots(spark, str(tmp_path / "s"), ".parquet", start="2024-01-03", end="2024-01-04")
    assert sorted(r.id for r in df.collect()) == [2, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_dates_from_the_time_axis_when_there_is_no_folder(spark):
    df = spark.createDataFrame([(at("2024-01-01 23:00:00"),), (at("2024-01-02 01:00:00"),)], "fetched_at timestamp_ntz")
    assert between_dates(df, start="2024-01-02").count() == 1


def test_drifted_types_and_columns_are_united(spark, tmp_path):
    root = str(tmp_path / "drift")
    spark.createDataFrame([(1, 7)], "k bigint, n bigint").write.parquet(root + "/date=2024-01-01")
    spark.createDataFrame([(2, 7.5, "x")], "k bigint, n double, extra string").write.parquet(root + "/date=2024-01-02")
    spark.createDataFrame([(3, "y")], "k bigint, extra string").write.parquet(root + "/date=2024-01-03")
    df = read_snapshots(spark, root, ".parquet", provenance=True)
    assert df.schema["n"].dataType.simpleString() == "double"
    assert rows_of(df, "k", "n", "extra") == [(1, 7.0, None), (2, 7.5, "x"), (3, None, "y")]
    assert [str(r[0]) for r in rows_of(df, "date")] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert df.where("filename LIKE '%date=2024-01-02%'").count() == 1
    glob = read_snapshots(spark, root + "/**/*.parquet")
    assert rows_of(glob, "k", "n", "extra") == rows_of(df, "k", "n", "extra")


# -- canonical form ------------------------------------------------------------

def test_canonicalise_renames_casts_and_fills(spark):
    df = spark.createDataFrame([("7", 1704067200, 1704067200.5, 1)],
                               "station_id string, ingested_at bigint, last_reported double, is_renting int")
    got = canonicalise(df, STATUS, LANDED_RENAMES)
    assert got.schema.fieldNames() == STATUS.fieldNames()
    row = got.first()
    assert (row.station_id, row.fetched_at, row.last_reported) == (
        7, at("2024-01-01 00:00:00"), at("2024-01-01 00:00:00.5"))
    assert row.is_renting is True and row.capacity is None if "capacity" in got.columns else row.mechanical is None
    assert str(row.date) == "2024-01-01"


def test_canonicalise_keeps_the_instant_of_zoned_times(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        df = spark.sql("SELECT 1 AS station_id, TIMESTAMP '2024-07-01 12:00:00+02:00' AS fetched_at, 9 AS more")
        row = canonicalise(df, INFO, extras=True).first()
        assert row.fetched_at == at("2024-07-01 10:00:00") and row.more == 9
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# -- envelopes -----------------------------------------------------------------

@pytest.mark.parametrize("shape", ["data", "stations", "flat"])
@pytest.mark.parametrize("indent", [None, 2])
def test_every_envelope_shape_converts_alike(spark, tmp_path, shape, indent):
    one, two = station(1), station(2, types=[])
    payload = {"data": envelope(one, two), "stations": {"stations": [one, two]}}.get(shape)
    name = tmp_path / "in/20240101T101500Z.json"
    if shape == "flat":
        put(name, "\n".join(json.dumps(s) for s in (one, two)) if indent is None else json.dumps([one, two], indent=2))
    else:
        put(name, payload, indent)
    written = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), ".json")
    assert (written.rows, written.total) == (2, 2)
    out = read_snapshots(spark, str(tmp_path / "out"), ".parquet")
    assert [f.name for f in out.schema.fields] == STATUS.fieldNames()
    assert rows_of(out, "station_id", "mechanical", "ebike", "is_renting", "last_reported", "fetched_at", "date") == [
        (1, 3, 2, False, at("2024-01-01 00:00:00"), at("2024-01-01 10:15:00"), at("2024-01-01").date()),
        (2, 0, 0, False, at("2024-01-01 00:00:00"), at("2024-01-01 10:15:00"), at("2024-01-01").date())]


def test_first_wins_and_last_wins(spark):
    row = (1, 0, ([(1, "1", 4, 1, [(3, None), (5, None)], 1, 1, 1, 0), (2, "2", 4, 1, None, 1, 1, 1, 0)],),
           "x/20240101T000000Z.json")
    df = spark.createDataFrame([row], T.StructType([*ENVELOPE.fields, T.StructField("filename", T.StringType())]))
    assert rows_of(flat_status(df), "station_id", "mechanical", "ebike") == [(1, 3, 0), (2, 0, 0)]
    landed = landed_rows(df)
    assert rows_of(landed, "station_id", "mechanical", "ebike") == [(1, 5, None), (2, None, None)]
    # a feed time of 0 counts as not given
    assert rows_of(landed, "feed_last_updated", "ingested_at")[0] == (1, at("2024-01-01"))


def test_empty_station_list_gives_no_row(spark):
    df = spark.createDataFrame([((([],),))], "data struct<stations:array<struct<station_id:bigint>>>")
    assert flatten_envelope(df).count() == 0


def test_rewriting_replaces_only_the_dates_it_touches(spark, tmp_path):
    out = str(tmp_path / "out")
    for day, bikes in (("20240101", 1), ("20240102", 2)):
        put(tmp_path / f"{day}/{day}T000000Z.json", envelope(station(1, bikes)))
        convert(spark, str(tmp_path / day), out, ".json")
    put(tmp_path / "again/20240102T000000Z.json", envelope(station(1, 9)))
    written = convert(spark, str(tmp_path / "again"), out, ".json")
    assert (written.rows, written.total) == (1, 2)
    assert rows_of(spark.read.parquet(out), "num_bikes_available") == [(1,), (9,)]


def test_bad_stamp_fails_or_is_set_aside(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", envelope(station(1)))
    put(tmp_path / "in/nameless.json", envelope(station(2), station(3)))
    with pytest.raises(Exception, match="no collection stamp"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "strict"), ".json")
    aside = str(tmp_path / "aside")
    written = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), ".json", bad_stamps=aside)
    assert written.rows == 1
    assert spark.read.parquet(aside).select(F.inline("data.stations")).count() == 2


def test_only_the_first_json_dataset_is_converted(spark, tmp_path):
    put(tmp_path / "raw/a/date=2024-01-01/20240101T000000Z.json", envelope(station(1)))
    put(tmp_path / "raw/b/date=2024-01-01/20240101T000000Z.json", envelope(station(2), station(3)))
    written = convert_first(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert written.rows == 1
    assert convert_first(spark, str(tmp_path / "out"), str(tmp_path / "none")) is None


def test_landing_keeps_feed_fields_and_refuses_an_empty_feed(spark, tmp_path):
    put(tmp_path / "in/20240101T000000Z.json", envelope(station(1, extra="kept"), lastUpdatedOther=0))
    df = read_snapshots(spark, str(tmp_path / "in"), ".json", provenance=True)
    assert land(df, str(tmp_path / "out")).rows == 1
    row = landed(spark, str(tmp_path / "out")).first()
    assert (row.extra, row.mechanical, row.feed_last_updated) == ("kept", 3, 1704067260)
    assert "num_bikes_available_types" not in row.asDict()
    put(tmp_path / "in/20240101T001500Z.json", envelope())
    df = read_snapshots(spark, str(tmp_path / "in"), ".json", schema=ENVELOPE, provenance=True)
    with pytest.raises(EmptyFeed):
        land(df, str(tmp_path / "refused"))
    assert not (tmp_path / "refused").exists()


def test_report_is_written(spark, tmp_path):
    report = spark.createDataFrame([("volume", "n", 1.0, "OK")], "section string, metric string, value double, verdict string")
    write_report(report, str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    with pytest.raises(ValueError):
        write_report(report, str(tmp_path / "x"), "xml")


def test_json_files_of_any_layout(spark, tmp_path):
    put(tmp_path / "in/a.json", envelope(station(1)), indent=2)
    put(tmp_path / "in/b.json", "\n".join(" " + json.dumps(envelope(station(i))) for i in (2, 3)))
    put(tmp_path / "in/c.json", "\n\n".join(json.dumps(envelope(station(i)), indent=2) for i in (4, 5)))
    put(tmp_path / "in/d.json", "".join(json.dumps(envelope(station(i))) for i in (6, 7)))
    put(tmp_path / "in/e.json", [envelope(station(8)), envelope(station(9))])
    put(tmp_path / "in/f.json", " \n")
    for schema in (None, ENVELOPE):
        rows = flatten_envelope(read_snapshots(spark, str(tmp_path / "in"), ".json", schema=schema))
        assert rows_of(rows, "station_id") == [(n,) for n in range(1, 10)]
    put(tmp_path / "bad/x.json", '{"a": 1} {"a": ')
    with pytest.raises(Exception, match="x.json"):
        read_snapshots(spark, str(tmp_path / "bad"), ".json")


@pytest.mark.parametrize("texts", [
    ['{"a": "x } {y"}', '{"a": "}{"}'], ['{"a": "q\\" }\\n{"}', "[1, [2], {\"b\": []}]", "{}"], ['{"a": "\\\\"}', '{"a": "}  [ ] { \\\\\\""}'],
    ['{"a": {"b": [{}, {"c": "] ["}]}}'] * 3, ["{}"], []])
@pytest.mark.parametrize("between", ["", "\n", " \r\n\t"])
def test_documents_are_cut_outside_strings(spark, texts, between):
    found = spark.createDataFrame([(between + between.join(texts) + between,)], "t string").select(documents(F.col("t"))).first()[0]
    assert found == texts and [json.loads(x) for x in found] == [json.loads(x) for x in texts]


def test_schema_of_all_documents(spark, tmp_path):
    put(tmp_path / "in/a.json", "\n".join(map(json.dumps, [
        {"n": 1, "x": 1, "deep": {"a": [1]}, "none": None}, {"n": 2.5, "x": "t", "deep": {"b": {"c": True}}, "odd key": 1}, {"x": {"y": [1]}}])))
    df = read_snapshots(spark, str(tmp_path / "in"), ".json")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {"n": "double", "x": "string", "deep": "struct<a:array<bigint>,b:struct<c:boolean>>", "none": "string", "odd key": "bigint"}
    assert rows_of(df, "n", "x", "deep.a", "deep.b.c", "`odd key`") == sorted(
        [(1.0, "1", [1], None, None), (2.5, "t", None, True, 1), (None, '{"y":[1]}', None, None, None)],
        key=lambda r: tuple((v is None, str(v)) for v in r))


def test_csv_types_come_from_all_values(spark, tmp_path):
    lines = ["i,f,b,d,t,z,s,mixed,empty"] + [f"{n},{n}.5,true,2024-01-0{n % 9 + 1},2024-01-01 10:00:0{n % 10},2024-01-01T10:00:00+01:00,x{n},{n},"
                                             for n in range(300)] + ["-7,1e3,FALSE,2024-02-29,2024-01-01T10:00,2024-01-01T10:00:00Z,,oops,"]
    put(tmp_path / "in/a.csv", "\n".join(lines))
    strict = read_snapshots(spark, str(tmp_path / "in"), ".csv")
    kinds = {f.name: f.dataType.simpleString() for f in strict.schema.fields}
    assert kinds == {"i": "bigint", "f": "double", "b": "boolean", "d": "date", "t": "timestamp_ntz", "z": "timestamp_ntz", "s": "string",
                     "mixed": "string", "empty": "string"}
    last = strict.where("i = -7").first()
    assert (last.f, last.b, last.d, last.t, last.s, last.mixed) == (1000.0, False, dt.date(2024, 2, 29), at("2024-01-01 10:00:00"), None, "oops")
    assert strict.where("i = 3").first().z == at("2024-01-01 09:00:00")
    loose = read_snapshots(spark, str(tmp_path / "in"), ".csv", tolerance=0.01, provenance=True)
    assert loose.schema["mixed"].dataType == T.LongType() and loose.where("unfit IS NOT NULL").count() == 1
    assert loose.where("i = -7").first().unfit == {"mixed": "oops"} and loose.where("filename LIKE '%a.csv'").count() == 301


@pytest.mark.parametrize("a,b,both", [
    ("decimal(12,2)", "bigint", "decimal(21,2)"), ("decimal(12,2)", "decimal(20,3)", "decimal(20,3)"), ("decimal(38,2)", "decimal(38,30)", "double"),
    ("decimal(5,1)", "double", "double"), ("boolean", "int", "int"), ("boolean", "double", "double"), ("boolean", "string", "string"),
    ("smallint", "float", "float"), ("int", "float", "double"), ("date", "timestamp_ntz", "timestamp_ntz"), ("void", "int", "int"),
    ("struct<a:int,b:string>", "struct<a:double,c:date>", "struct<a:double,b:string,c:date>"), ("array<int>", "array<bigint>", "array<bigint>"),
    ("map<string,int>", "map<string,decimal(3,1)>", "map<string,decimal(11,1)>"), ("struct<a:int>", "int", "string")])
def test_wider_types(a, b, both):
    one, other, want = (T.StructType.fromDDL(f"x {x}")["x"].dataType for x in (a, b, both))
    assert wider(one, other) == want
    if not isinstance(want, T.StructType):
        assert wider(other, one) == want


def test_inspection_flattens_and_judges(spark, tmp_path):
    put(tmp_path / "raw/status/date=2024-01-01/20240101T000000Z.json", envelope(station(1), station(2)), indent=1)
    put(tmp_path / "raw/info/i.csv", "station_id,capacity\n1,20\n1,21\n")
    info, status = inspect_tree(spark, str(tmp_path / "raw"))
    assert (info.dataset, info.n_files, info.flattened, info.conformance) == ("info", 1, False, None)
    assert info.bounds.first().asDict() == {"n_lignes": 2, "n_stations": 1}
    assert status.flattened and status.bounds.first().asDict() == {"n_lignes": 2, "n_stations": 2}
    missing = {r.column for r in status.conformance.where("check = 'required' AND NOT ok").collect()}
    assert missing == {"fetched_at"}


def test_audit_from_paths(spark, tmp_path):
    for minute in (0, 15, 30):
        put(tmp_path / f"in/20240101T00{minute:02d}00Z.json", envelope(station(1), station(2, 6)))
    convert(spark, str(tmp_path / "in"), str(tmp_path / "status"), ".json")
    spark.createDataFrame([(1, 5), (2, 30)], "station_id bigint, capacity bigint").withColumn(
        "fetched_at", F.expr("timestamp_ntz'2024-01-01'")).write.parquet(str(tmp_path / "info"))
    run_audit(spark, f"{tmp_path}/status/**/*.parquet", str(tmp_path / "report"), str(tmp_path / "info"), fmt="json")
    found = {r.metric: (r.value, r.verdict) for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert found["n_lignes"][0] == 6 and found["pire_trou_min"] == (15.0, "OK")
    assert found["depasse_capacite"][0] == 3 and found["part_depasse_capacite"] == (0.5, "PROBLÈME")
    assert found["types_incoherents"][0] == 3 and found["pct_remplies"] == (100.0, "OK")


def test_landing_keeps_earlier_runs_of_a_day(spark, tmp_path):
    for minute, bikes in ((0, 5), (15, 6)):
        put(tmp_path / f"in{minute}/20240101T00{minute:02d}00Z.json", envelope(station(1, bikes), lastUpdatedOther=0))
        run = read_snapshots(spark, str(tmp_path / f"in{minute}"), ".json", provenance=True)
        assert land(run, str(tmp_path / "out")).rows == 1
    again = read_snapshots(spark, str(tmp_path / "in0"), ".json", provenance=True)
    written = land(again, str(tmp_path / "out"))
    assert (written.rows, written.total) == (0, 2)


def test_a_run_lands_in_several_calls_and_only_once(spark, tmp_path):
    def call(name, *stations):
        put(tmp_path / name / "20240101T000000Z.json", envelope(*stations, lastUpdatedOther=0))
        return read_snapshots(spark, str(tmp_path / name), ".json", provenance=True)

    dest = str(tmp_path / "out")
    first, second = call("a", station(1), station(2)), call("b", station(2), station(3, 7))
    name, manifest = stage(first, dest)  # cut off before it is published
    assert landed(spark, dest) is None and (land(first, dest).rows, land(first, dest).rows) == (2, 0)
    assert rows_of(landed(spark, dest), "station_id") == [(1,), (2,)]
    name, manifest = stage(second, dest)
    assert rows_of(landed(spark, dest), "station_id") == [(1,), (2,)]
    publish(manifest, dest, name)
    written = land(second, dest)
    assert (written.rows, written.total) == (0, 3)
    assert rows_of(landed(spark, dest), "station_id", "date") == [(n, dt.date(2024, 1, 1)) for n in (1, 2, 3)]
    assert landed(spark, dest, [dt.date(2025, 1, 1)]) is None


def test_calls_with_other_columns_are_united(spark, tmp_path):
    dest = str(tmp_path / "out")
    for at_hour, more in ((0, {"extra": 1}), (1, {"extra": 1.5, "other": "x"})):
        put(tmp_path / f"{at_hour}/20240101T0{at_hour}0000Z.json", envelope(station(1, **more), lastUpdatedOther=0))
        land(read_snapshots(spark, str(tmp_path / f"{at_hour}"), ".json", provenance=True), dest, call=f"hour-{at_hour}")
    assert rows_of(landed(spark, dest), "extra", "other") == [(1.0, None), (1.5, "x")]


def test_quarantine_holds_a_file_once(spark, tmp_path):
    put(tmp_path / "in/unnamed.json", envelope(station(1)))
    for _ in range(2):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), ".json", bad_stamps=str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_object_store_paths_are_named_as_spark_names_them():
    assert located("s3://feed/raw") == "s3a://feed/raw"
    assert located("s3a://feed/s3://x") == "s3a://feed/s3://x" and located("/data/s3") == "/data/s3"
