"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_DIR, status_row
from snapgrid.operators.envelope import flat_status, landed_rows
from snapgrid.plans.audit import AGREE, BAD, DIVERGE, GOOD, LIMITS, WATCH, audit, verdicts
from snapgrid.plans.workload import QUERIES, _landing
from snapgrid.schema import ENVELOPE
from snapgrid.sources.documents import documents

WRITES_FIRST = {"convert_roundtrip", "stream_ingest", "stream_repeated", "land_two_runs", "dq_checks",
                "csv_json_roundtrip", "union_by_name", "union_by_name_wide", "json_multiline_inferred", "csv_inferred",
                "discover_files", "discover_counted", "report_stored", "verdicts_by_days", "sketched_figures", "target_stored_grid"}
PLANNED = sorted(set(QUERIES) - WRITES_FIRST)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in plan


@pytest.mark.parametrize("name", PLANNED)
def test_nested_loops_only_meet_one_row_aggregates(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR)).splitlines()
    for i, line in enumerate(plan):
        if "BroadcastNestedLoopJoin" not in line:
            continue
        depth = line.index("BroadcastNestedLoopJoin")
        below = [x for x in plan[i + 1:] if re.search(r"\w", x)]
        side = []
        for x in below:
            if re.search(r"\w", x).start() <= depth:
                break
            side.append(x)
        start = max(j for j, x in enumerate(side) if "BroadcastExchange" in x
                    and re.search(r"\w", x).start() == re.search(r"\w", side[0]).start())
        aggregates = [x for x in side[start:] if "Aggregate" in x]
        assert "keys=[]" in aggregates[0], "\n".join(side[start:start + 6])


def test_latest_reference_limits_groups_before_the_shuffle(spark):
    plan = plan_of(QUERIES["latest_reference"](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["obs_latest_per_bucket", "frozen_sensors", "target_pairs", "grid_fill"])
def test_hot_path_uses_hash_aggregation(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("name,reused,scans", [("cadence_daily_events", 2, 1), ("freshness", 2, 2)])
def test_levels_share_one_shuffle(spark, name, reused, scans):
    plan = final_plan(QUERIES[name](spark, SF_DIR))
    assert plan.count("ReusedExchange") == reused
    assert plan.count("FileScan") == scans


def test_grid_has_neither_join_nor_extra_shuffle(spark):
    plan = plan_of(QUERIES["grid_cells"](spark, SF_DIR))
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 2


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["worst_holes_top5"](spark, SF_DIR))


@pytest.mark.parametrize("name,columns", [("stations_daily", {"ts", "user_id"}), ("stations_gone", {"ts", "user_id"}),
                                          ("cadence_daily", {"ts"}), ("profile_bounds", {"ts", "user_id"})])
def test_only_needed_columns_are_read(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    read = {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan)
            for c in schema.split(",") if c}
    assert read == columns


def test_verdict_levels_and_null(spark):
    rows = [("s", "taux_collecte", v) for v in (0.98, 0.97, 0.9, None)] + [
        ("s", "n_absentes", 0.0), ("s", "n_absentes", 29.0), ("s", "n_absentes", 30.0), ("s", "accord", 0.7),
        ("s", "accord", 0.71), ("s", "free", 1.0), ("s", "negatifs", 1.0), ("s", "part_nulls_bikes", 0.01)]
    df = spark.createDataFrame(rows, "section string, metric string, value double")
    assert [r.verdict for r in verdicts(df).collect()] == [
        GOOD, WATCH, BAD, BAD, GOOD, WATCH, BAD, DIVERGE, AGREE, None, BAD, BAD]
    assert len({limit.metric for limit in LIMITS}) == len(LIMITS)


def test_audit_of_a_single_run_without_reference(spark, make_status):
    status = make_status([status_row(1, "2024-01-01 10:00:00", 5, "2024-01-01 09:59:00", mechanical=5)])
    found = {r.metric: (r.value, r.verdict) for r in audit(status).collect()}
    assert found["pire_trou_min"] == (None, BAD)
    assert "depasse_capacite" not in found and "accord" not in found
    assert found["cases"] == (1.0, None) and found["pct_remplies"] == (100.0, GOOD)
    assert found["mae"] == (None, None)


@pytest.mark.parametrize("rows", [flat_status, landed_rows])
def test_a_stamp_is_read_once_per_envelope(spark, rows):
    schema = T.StructType([*ENVELOPE.fields, T.StructField("filename", T.StringType())])
    listed = {"stations": [{"station_id": 1}, {"station_id": 2}]}
    made = [(1, 0, listed, "a/20240101T000000Z.json"), (1, 0, {"stations": []}, "unstamped")]  # what lists nothing needs no stamp
    found = rows(spark.createDataFrame(made, schema).repartition(1))
    above = plan_of(found).split("Generate inline")[0]
    assert "regexp_extract" not in above and "Generate inline" in plan_of(found)
    assert found.count() == len(found.collect()) == 2
    with pytest.raises(Exception, match="no collection stamp"):
        rows(spark.createDataFrame([(1, 0, listed, "unstamped")], schema)).collect()


def test_a_text_is_cut_once(spark):
    found = spark.createDataFrame([('{"a": "x} {\\" y"}\n{"b": 1} [2]',)], "t string").repartition(1).select(documents(F.col("t")).alias("d"))
    assert plan_of(found).count("split(t#") == 1
    assert found.first()["d"] == ['{"a": "x} {\\" y"}', '{"b": 1}', "[2]"]


def test_files_of_the_stream_are_bounded(spark, tmp_path):
    ts = F.expr("timestamp_ntz '2024-01-01 00:00:00'") + F.expr("INTERVAL '10' SECOND") * F.col("id")
    (spark.range(4000).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("view").alias("event_type"),
                              F.lit(100.0).alias("value"), F.lit('{"k": 3}').alias("props")).write.parquet(str(tmp_path / "events.parquet")))
    root = _landing(spark, str(tmp_path), 2)
    files = spark.read.option("recursiveFileLookup", True).text(f"{root}/status").groupBy(F.input_file_name()).count().collect()
    assert sum(row["count"] for row in files) == 8 and max(row["count"] for row in files) == 2
