"""Landing feed envelopes exactly once: staged files, and a manifest that makes them count.

A call's rows go to a folder of its own, ``call=<name>/date=...``, and count from the moment its one-row manifest stands in
``_manifest``.  The call's name follows from its content, or is the caller's.  A call that is cut off leaves files that nobody
reads and that its repetition replaces; a call that is repeated after it was published does nothing.  Rows of a
station and instant that an earlier call published are not stored again, so a run may arrive in any number of calls.

Rows are found through the manifests: which folders count, how many rows they hold and by which schema they were written.  No
footer is opened for that.  One writer at a time is to feed a destination.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.operators.envelope import landed_rows, stations_path
from snapgrid.session import located
from snapgrid.sources.convert import EmptyFeed, Written
from snapgrid.sources.drift import common_schema, widened
from snapgrid.sources.sinks import write_by_date

KEY = ("station_id", "ingested_at")
MANIFEST = "call string, rows bigint, schema string, dates array<date>"


def calls(spark: SparkSession, dest: str) -> DataFrame:
    """(call, rows, schema, dates): one row per published call."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{located(dest).rstrip('/')}/_manifest")
    except AnalysisException:  # nothing is published yet
        return spark.createDataFrame([], MANIFEST)


def landed(spark: SparkSession, dest: str, dates: list | None = None) -> DataFrame | None:
    """The rows of all published calls, with ``date``; None where there are none.  ``dates`` prunes folders.

    Calls that were written with different schemas are united by name, each column by its widest type.
    """
    dest = located(dest).rstrip("/")
    published = calls(spark, dest).where("rows > 0")
    if dates is not None:
        published = published.where(F.arrays_overlap("dates", F.array(*[F.lit(day).cast("date") for day in dates]))) if dates \
            else published.where(F.lit(False))
    schemas: dict[str, list[str]] = {}
    for row in published.select("schema", "call").toLocalIterator():  # names of folders, as any listing has them
        schemas.setdefault(row["schema"], []).append(row["call"])
    if not schemas:
        return None
    kinds = {text: T.StructType.fromJson(json.loads(text)) for text in sorted(schemas)}
    common, parts = common_schema(list(kinds.values())), []
    for text, schema in kinds.items():
        folders = [f"{dest}/call={name}" for name in schemas[text]]
        part = spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.DateType())])).option("basePath", dest).parquet(*folders)
        if dates is not None:
            part = part.where(F.col("date").isin(dates))
        want = {f.name: f.dataType for f in common.fields}
        parts.append(part.select(*[widened(F.col(f"`{f.name}`"), f.dataType, want[f.name]).alias(f.name) for f in schema.fields], "date"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _name(envelopes: DataFrame, path: str) -> str:
    """A name that follows from the envelopes, whatever their order; an envelope without stations is refused."""
    seen = envelopes.agg(
        F.count_if(F.coalesce(F.size(F.col(path)), F.lit(0)) <= 0).alias("empty"), F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64(F.struct("*"))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.xxhash64(F.lit("second"), F.struct("*")).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("b")).first()
    if seen["empty"]:
        raise EmptyFeed("a feed lists no station")
    return f"c{seen['n']}-{seen['a'] & (1 << 64) - 1:016x}-{seen['b'].lstrip('-')}"


def stage(envelopes: DataFrame, dest: str, ingested_at: Column | None = None, call: str | None = None) -> tuple[str, DataFrame | None]:
    """(call, manifest row): the call's new rows written to its folder, where they do not count yet; no manifest if they count already."""
    path = stations_path(envelopes.schema)
    if path is None:
        raise ValueError("landing needs a feed envelope with a station list")
    spark, dest = envelopes.sparkSession, located(dest).rstrip("/")
    call = call or _name(envelopes, path)
    if not calls(spark, dest).where(F.col("call") == call).isEmpty():
        return call, None
    rows = landed_rows(envelopes, ingested_at).withColumn("date", F.to_date("ingested_at"))
    days = [row["date"] for row in rows.select("date").distinct().collect()]  # bounded by the calendar
    held = landed(spark, dest, [day for day in days if day is not None])
    if held is not None:
        seen = held.select(*[F.col(name).alias(f"held_{name}") for name in KEY]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"held_{name}")) for name in KEY])
        rows = rows.join(seen, same, "left_anti")
    count = Observation("staged")
    write_by_date(rows, f"{dest}/call={call}", seen=count, whole=True)  # what a call that was cut off left goes, whatever its dates
    schema = T.StructType([f for f in rows.schema.fields if f.name != "date"]).json()
    return call, spark.createDataFrame([(call, count.get["n"], schema, days)], MANIFEST)


def publish(manifest: DataFrame, dest: str, call: str) -> None:
    """Make a staged call count: one small file, put in place last."""
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{located(dest).rstrip('/')}/_manifest/part={call}")


def land(envelopes: DataFrame, dest: str, ingested_at: Column | None = None, call: str | None = None) -> Written:
    """Store feed envelopes as the collector's flat rows; read them with :func:`landed`.

    ``ingested_at`` defaults to the stamp in ``filename``, ``call`` to a name that follows from the content.  An
    envelope without stations aborts before anything is written, unless the call has a name: give one to save the scan for it.
    """
    name, manifest = stage(envelopes, dest, ingested_at, call)
    rows = 0
    if manifest is not None:
        rows = manifest.first()["rows"]
        publish(manifest, dest, name)
    total = calls(envelopes.sparkSession, dest).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return Written(rows, total)
