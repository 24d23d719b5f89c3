"""The registered queries: each operator over the whole of the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.functions.feed import stamp_of
from snapgrid.functions.numbers import round_to
from snapgrid.operators import baseline, checks, coverage, daystate, gridstore, islands, profile, timegrid
from snapgrid.operators.consistency import consistency
from snapgrid.operators.envelope import flat_status, landed_rows
from snapgrid.operators.freshness import freshness
from snapgrid.operators.latest import latest_per_bucket, latest_reference
from snapgrid.plans import standin
from snapgrid.plans.audit import audit, verdicts
from snapgrid.schema import ENVELOPE
from snapgrid.session import configure, scratch_dir
from snapgrid.sources.convert import convert
from snapgrid.sources.discover import discover
from snapgrid.sources.landing import land, landed, stage
from snapgrid.sources.readers import read_snapshots
from snapgrid.sources.sinks import write_report
from snapgrid.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

TIES = ["snap_id"]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: round_to(F.col(name), 6) for name in names})


def _on_status(operator: Callable[[DataFrame], DataFrame], source=standin.status) -> Query:
    return lambda spark, sf_dir: operator(source(configure(spark), sf_dir))


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with the file name they would have been landed under."""
    name = F.concat(F.lit("raw/status/"), "stamp", F.lit(".json")).alias("filename")
    return standin.envelopes(configure(spark), sf_dir).select(name, "last_updated", "lastUpdatedOther", "data")


# Fixed value: envelopes in a landed file that a stream reads whole, so that none grows with the data.
FILE_SIZE = 32


def _landing(spark: SparkSession, sf_dir: str, file_size: int = 0) -> str:
    """Envelopes written as JSON lines below ``status``, in a folder per date and run stamp, at most ``file_size`` in a file."""
    root = scratch_dir(spark, "landing")
    (standin.envelopes(configure(spark), sf_dir).hint("rebalance", "stamp")
     .write.option("maxRecordsPerFile", file_size).partitionBy("date", "stamp").json(f"{root}/status"))
    return root


def _consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return consistency(standin.status(spark, sf_dir), standin.info(spark, sf_dir), TIES)


def _damaged_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid that lost an hour of some stations and repeats another, and a target with values after the history's end."""
    configure(spark)
    path = scratch_dir(spark, "target")
    baseline.target(standin.status(spark, sf_dir)).select("station_id", "ts", "y", "y_imputed").write.parquet(path)
    stored = spark.read.parquet(path)
    lost, doubled = "station_id % 7 = 3 AND hour(ts) = 5", "station_id % 7 = 3 AND hour(ts) = 6"
    copies = F.when(F.expr(lost), 0).when(F.expr(doubled), 2).otherwise(1)
    torn = stored.select("station_id", "ts", F.explode(F.array_repeat(F.lit(True), copies)).alias("copy"))
    late = F.when((F.col("station_id") % 5 == 1) & F.col("y_imputed").isNull(), F.lit(1))
    return checks.dq_checks(standin.damaged_status(spark, sf_dir), torn, stored.withColumn("y", F.coalesce("y", late)))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return _rounded(audit(standin.status(spark, sf_dir), standin.info(spark, sf_dir), ties=TIES), "value")


def _verdicts_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit from a state that was stored in two steps, the later days added to the earlier ones."""
    status, dest = standin.status(configure(spark), sf_dir), scratch_dir(spark, "day-state")
    first = status.agg(F.min(F.to_date("fetched_at")).alias("d")).first()["d"]
    daystate.update_days(status.where(F.col("fetched_at") < F.lit(first).cast("timestamp_ntz") + F.expr("INTERVAL 9 DAYS")), dest)
    daystate.update_days(status, dest)
    return _rounded(audit(status, standin.info(spark, sf_dir), ties=TIES, state=spark.read.parquet(dest)), "value")


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures from sketches kept per day beside the exact ones: the exact value, and whether the estimate is near it."""
    status, path, accuracy = standin.status(configure(spark), sf_dir), scratch_dir(spark, "day-sketches"), 0.01
    daystate.day_sketches(status, accuracy).write.parquet(path)
    days = spark.read.parquet(path)
    parts = []
    for section, exact, merged, direct, names, key in (
            ("volume", coverage.volume(status), daystate.volume_of_days(days), coverage.volume(status, accuracy=accuracy),
             ["n_runs", "n_stations"], None),
            ("freshness", freshness(status), daystate.freshness_of_days(days), freshness(status, accuracy=accuracy),
             ["p50_s", "p90_min", "p99_h", "max_h", "pct_sup_6h", "pct_sup_24h"], None),
            ("stations_daily", coverage.keys_per_day(status), daystate.keys_of_days(days), coverage.keys_per_day(status, accuracy),
             ["n_stations"], "jour")):
        by = [key] if key else []
        for form, found in (("merged", merged), ("direct", direct)):
            found = found.select(*by, *[F.col(n).cast("double").alias(f"est_{n}") for n in names])
            both = exact.join(found, by) if by else exact.crossJoin(F.broadcast(found))
            near = {n: F.abs(F.col(f"est_{n}") - F.col(n)) <= 5 * accuracy * F.abs(F.col(n)) + 0.5 for n in names}
            rows = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), near[n].alias("near"))
                                      for n in names]))
            parts.append(both.select(F.lit(section).alias("section"), F.lit(form).alias("form"),
                                     (F.col(key) if key else F.lit(None).cast("date")).alias("jour"), rows))
    return reduce(DataFrame.unionByName, parts)


def _convert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = scratch_dir(spark, "status")
    convert(spark, _landing(spark, sf_dir), dest, ".json", schema=ENVELOPE, multiline=False)
    return read_snapshots(spark, dest, ".parquet")


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing, dest = _landing(spark, sf_dir, FILE_SIZE), scratch_dir(spark, "stream")
    checkpoint = scratch_dir(spark, "checkpoint")
    # the second run finds nothing new
    for _ in range(2):
        ingest_stream(spark, landing, dest, checkpoint).awaitTermination()
    return spark.read.parquet(dest)


def _repeated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive twice, in other batches and in another run, some of them behind the watermark."""
    landing, dest, checkpoint = scratch_dir(spark, "landing"), scratch_dir(spark, "stream"), scratch_dir(spark, "checkpoint")
    envelopes = standin.envelopes(configure(spark), sf_dir).hint("rebalance", "stamp")
    for folder, part in (("a", "day(date) % 2 = 0"), ("b", "day(date) % 3 <> 0"), ("c", "true")):
        envelopes.where(part).write.option("maxRecordsPerFile", FILE_SIZE).partitionBy("date", "stamp").json(f"{landing}/{folder}")
        ingest_stream(spark, landing, dest, checkpoint).awaitTermination()
    return spark.read.parquet(dest)


def _land_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's envelopes in two calls that overlap, both repeated, one of them cut off before it was published."""
    dest, whole = scratch_dir(spark, "landed"), _stamped(spark, sf_dir)
    part = F.xxhash64("last_updated") % 4
    first, second = whole.where(part <= 0), whole.where(part >= 0)
    stage(first, dest)
    for envelopes in (first, second, first, second):
        land(envelopes, dest)
    return landed(spark, dest).select("station_id", "mechanical", "ebike", "ingested_at")


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    second = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    name = F.concat(F.lit("raw/status/date="), day, F.lit("/"), second, F.lit(".json"))
    return (standin.table(configure(spark), sf_dir, "events").select("event_id", name.alias("filename"))
            .withColumn("fetched_at", stamp_of("filename")))


def _counted(findings: DataFrame, source: DataFrame) -> DataFrame:
    return findings.crossJoin(F.broadcast(source.agg(F.count("*").alias("n_lignes"))))


def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standin.table(configure(spark), sf_dir, "events")
    return _counted(profile.describe(events), events)


def _conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = standin.status(configure(spark), sf_dir)
    return _counted(profile.conformance(status), status)


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standin.table(configure(spark), sf_dir, "events")
    root = scratch_dir(spark, "formats")
    text = events.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text.option("header", True).csv(f"{root}/csv")
    text.json(f"{root}/ndjson")
    text.option("compression", "gzip").json(f"{root}/gz")
    events.write.parquet(f"{root}/parquet")
    folders = {".csv": "csv", ".ndjson": "ndjson", ".gz": "gz", ".parquet": "parquet"}
    parts = [read_snapshots(spark, f"{root}/{folder}", ext, schema=events.schema, multiline=False)
             .select(F.lit(ext).alias("ext"), "*") for ext, folder in folders.items()]
    return reduce(DataFrame.unionByName, parts)


def _drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of files that disagree on a type and on their columns."""
    events = standin.table(configure(spark), sf_dir, "events")
    root = scratch_dir(spark, "drift")
    even, odd = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    even.select("event_id", "user_id", "value").write.parquet(root)
    (odd.select("event_id", F.col("user_id").cast("double").alias("user_id"), "event_type")
     .write.mode("append").parquet(root))
    return read_snapshots(spark, root, ".parquet")


def _drifted_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of files that disagree on decimals, truth values and nested columns."""
    events = standin.table(configure(spark), sf_dir, "events")
    root, cents = scratch_dir(spark, "drift"), F.round(F.col("value") * 100).cast("bigint")
    plain = F.struct("user_id", cents.cast("int").alias("cents"))
    nested = F.struct(F.col("user_id").cast("double").alias("user_id"), F.struct((F.col("event_id") % 5).alias("five")).alias("more"))
    batches = [
        ("event_id % 3 = 0", cents.cast("decimal(12,2)"), F.col("user_id") % 2 == 0, plain, F.array(F.col("event_id").cast("int"))),
        ("event_id % 3 = 1", cents, (F.col("user_id") % 7).cast("int"), nested, F.array(F.col("event_id").cast("double") / 2)),
        ("event_id % 3 = 2", (cents / 1000).cast("decimal(20,3)"), (F.col("user_id") % 3).cast("tinyint"), plain, F.array().cast("array<int>")),
    ]
    for where, amount, flag, pair, values in batches:
        rows = events.where(where).select("event_id", amount.alias("amount"), flag.alias("flag"), pair.alias("pair"), values.alias("list"))
        rows.write.mode("append").parquet(root)
    found = read_snapshots(spark, root, ".parquet")
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return found.select("event_id", F.col("amount").cast("string").alias("amount"), F.col("flag").cast("int").alias("flag"),
                        F.col("pair.user_id").alias("pair_user"), F.col("pair.cents").alias("pair_cents"), F.col("pair.more.five").alias("five"),
                        F.get("list", F.lit(0)).alias("first"), F.lit(kinds["amount"]).alias("amount_type"), F.lit(kinds["flag"]).alias("flag_type"))


def _json_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several documents over several lines each, their schema inferred."""
    root = scratch_dir(spark, "spanning")
    text = F.to_json(F.struct("last_updated", "lastUpdatedOther", "data"), {"pretty": "true"})
    (standin.envelopes(configure(spark), sf_dir).select("date", "stamp", text.alias("value")).hint("rebalance", "stamp")
     .write.partitionBy("date", "stamp").text(root))
    return flat_status(read_snapshots(spark, root, ".json", provenance=True))


def _csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every type, one with a few values of another type far into the files."""
    events = standin.table(configure(spark), sf_dir, "events")
    root = scratch_dir(spark, "csv-source")
    value = F.when(F.col("event_id") % 1000 == 999, F.lit("unknown")).otherwise(F.col("value").cast("string"))
    (events.select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", value.alias("value"), "props",
                   (F.col("user_id") % 2 == 0).alias("even"))
     .write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("header", True).csv(root))
    found = read_snapshots(spark, root, ".csv", tolerance=0.01)
    return found.select(*[c for c in found.columns if c != "unfit"], F.element_at("unfit", "value").alias("unfit_value"),
                        F.coalesce(F.size("unfit"), F.lit(0)).alias("n_unfit"))


def _discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _landing(spark, sf_dir)
    standin.info(spark, sf_dir).write.parquet(f"{root}/information")
    return discover(spark, root)


def _stored_grid(spark: SparkSession, sf_dir: str, source=standin.status) -> DataFrame:
    """The target from a grid that is stored in two steps, the later days appended to the earlier ones."""
    status = source(configure(spark), sf_dir)
    cut = F.lit(status.agg(F.min(F.to_date("fetched_at")).alias("d")).first()["d"]).cast("timestamp_ntz") + F.expr("INTERVAL 9 DAYS")
    store = gridstore.GridStore(spark, f"grid_{uuid.uuid4().hex}", buckets=8)
    store.append(status.where(F.col("fetched_at") < cut))
    store.append(status.where(F.col("fetched_at") >= cut))
    return store.target()


def _counted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets below a folder, one file for each run of one and one for all of the other."""
    root = scratch_dir(spark, "tree")
    (standin.envelopes(configure(spark), sf_dir).repartition("stamp").write.partitionBy("date", "stamp").json(f"{root}/status"))
    standin.info(spark, sf_dir).coalesce(1).write.parquet(f"{root}/information")
    return discover(spark, root).select("dataset", "ext", "n_files", (F.col("bytes") > 0).alias("has_bytes"))


def _preview(width: int) -> Query:
    return lambda spark, sf_dir: profile.preview(standin.feed_rows(configure(spark), sf_dir), 3, width, ["event_id"])


def _stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report stored in each format and read back."""
    status, root = standin.status(configure(spark), sf_dir), scratch_dir(spark, "report")
    counts = consistency(status, standin.info(spark, sf_dir), TIES)
    names = [name for name in counts.columns if name != "n"]
    rows = F.inline(F.array(*[F.struct(F.lit("coherence").alias("section"), F.lit(f"part_{name}").alias("metric"),
                                       round_to(F.col(name) / F.col("n"), 6).alias("value")) for name in names]))
    report, parts = verdicts(counts.select(rows)), []
    for fmt in ("parquet", "json", "csv"):
        write_report(report, f"{root}/{fmt}", fmt)
        stored = spark.read.schema(report.schema).option("header", True).format(fmt).load(f"{root}/{fmt}")
        parts.append(stored.select(F.lit(fmt).alias("fmt"), "*"))
    return reduce(DataFrame.unionByName, parts)


QUERIES: dict[str, Query] = {
    "volume_coverage": _on_status(lambda s: _rounded(coverage.volume(s), "jours", "runs_attendus", "taux_collecte")),
    "cadence_daily": _on_status(coverage.cadence, standin.run_status),
    "cadence_daily_events": _on_status(coverage.cadence),
    "cadence_total": _on_status(lambda s: coverage.cadence_summary(coverage.cadence(s)), standin.run_status),
    "stations_daily": _on_status(coverage.keys_per_day),
    "stations_amplitude": _on_status(lambda s: coverage.keys_amplitude(coverage.keys_per_day(s))),
    "stations_gone": _on_status(coverage.keys_gone),
    "freshness": _on_status(freshness),
    "consistency": _consistency,
    "consistency_no_reference": _on_status(consistency),
    "frozen_sensors": _on_status(islands.frozen),
    "frozen_agreement": _on_status(lambda s: _rounded(islands.frozen_agreement(islands.frozen(s)), "accord")),
    "islands": _on_status(lambda s: _rounded(islands.islands(s), "duree_h", "fraicheur_max_h")),
    "latest_reference": _on_status(lambda info: latest_reference(info, TIES), standin.info),
    "obs_latest_per_bucket": _on_status(latest_per_bucket),
    "grid_cells": _on_status(timegrid.grid),
    "grid_fill": _on_status(timegrid.fill_rate),
    "grid_fill_25min": _on_status(lambda s: timegrid.fill_rate(s, 25)),
    "worst_holes_top5": _on_status(timegrid.worst_holes),
    "target_cells": _on_status(baseline.target),
    "target_pairs": _on_status(baseline.target_pairs),
    "target_stored_grid": _stored_grid,
    "grid_fill_45min": _on_status(lambda s: timegrid.fill_rate(s, 45)),
    "target_pairs_45min": _on_status(lambda s: baseline.target_pairs(s, 45)),
    "mae_overall": _on_status(lambda s: baseline.persistence_mae(baseline.target_pairs(s))),
    "mae_by_slot": _on_status(lambda s: baseline.persistence_mae_by_slot(baseline.target_pairs(s))),
    "mae_by_slot_fixed_offset": _on_status(
        lambda s: baseline.persistence_mae_by_slot(baseline.target_pairs(s, tz="fixed+2"))),
    "verdicts": _verdicts,
    "verdicts_by_days": _verdicts_by_days,
    "sketched_figures": _sketched,
    "dq_checks": _damaged_checks,
    "cadence_daily_nulls": _on_status(coverage.cadence, standin.gappy_status),
    "grid_cells_nulls": _on_status(timegrid.grid, standin.gappy_status),
    "grid_fill_nulls": _on_status(timegrid.fill_rate, standin.gappy_status),
    "worst_holes_nulls": _on_status(timegrid.worst_holes, standin.gappy_status),
    "target_cells_nulls": _on_status(baseline.target, standin.gappy_status),
    "target_pairs_nulls": _on_status(baseline.target_pairs, standin.gappy_status),
    "envelope_flatten": lambda spark, sf_dir: flat_status(_stamped(spark, sf_dir)),
    "type_merge_last_wins": lambda spark, sf_dir: landed_rows(_stamped(spark, sf_dir)).select(
        "station_id", "stationCode", "mechanical", "ebike"),
    "landed_snapshots": lambda spark, sf_dir: landed_rows(_stamped(spark, sf_dir)).select(
        "station_id", "mechanical", "ebike", "ingested_at"),
    "land_two_runs": _land_two_runs,
    "convert_roundtrip": _convert_roundtrip,
    "stamp_from_filename": _stamps,
    "profile_bounds": _on_status(profile.bounds),
    "schema_describe": _describe,
    "schema_conformance": _conformance,
    "csv_json_roundtrip": _formats,
    "union_by_name": _drifted,
    "union_by_name_wide": _drifted_wide,
    "json_multiline_inferred": _json_spanning,
    "csv_inferred": _csv_inferred,
    "stream_ingest": _stream_ingest,
    "stream_repeated": _repeated_stream,
    "discover_files": _discover,
    "discover_counted": _counted_files,
    "preview_nested": _preview(34),
    "preview_nested_whole": _preview(1000),
    "report_stored": _stored_report,
}
