"""Landed feed files to date-partitioned status rows, restartable."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from snapgrid.functions.time import DAY, micros
from snapgrid.operators.envelope import flat_status
from snapgrid.schema import ENVELOPE, STATUS
from snapgrid.session import located
from snapgrid.sources.documents import documents

KEY = ["station_id", "fetched_at"]
WATERMARK = "1 day"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Days whose keys are kept apart from each other.
SLOTS = 4


def read_landing(spark: SparkSession, landing: str, schema: T.StructType = ENVELOPE, *,
                 multiline: bool | None = None, max_files: int | None = None) -> DataFrame:
    """Streaming status rows of the JSON files that arrive below ``landing``.

    By default each file is read whole and cut into its documents, however they
    are laid out.  ``multiline=False`` says that all hold one per line,
    and lets large files be read in pieces; ``multiline=True`` that all hold one.
    """
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if multiline is not None:
        df = reader.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(landing)
        return flat_status(df.withColumn("filename", F.col("_metadata.file_path")))
    whole = reader.text(landing, wholetext=True).withColumn("filename", F.col("_metadata.file_path"))
    found = whole.select("filename", F.explode(documents(F.col("value"))).alias("document"))
    parsed = F.from_json("document", schema, {"mode": "FAILFAST"})
    return flat_status(found.select(parsed.alias("d"), "filename").select("d.*", "filename"))


def _first_seen(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A group's rows that are the first of their key, and all rows that the state cannot judge, marked late.

    The state holds the keys seen that the watermark has not passed; a row behind it is late.
    """
    watermark = state.getCurrentWatermarkMs() * 1000
    held = [np.frombuffer(part, np.int64) for part in state.get] if state.exists else [np.zeros(0, np.int64)] * 2
    live = held[1] >= watermark
    seen = pd.MultiIndex.from_arrays([part[live] for part in held])
    for frame in frames:
        late = (frame["unkeyed"] | (frame["micros"] < watermark)).to_numpy(dtype=bool)
        keys = pd.MultiIndex.from_arrays([frame["station"], frame["micros"]])
        fresh = ~late & ~(keys.isin(seen) | keys.duplicated())
        seen = seen.append(keys[fresh])
        yield frame.assign(late=late)[late | fresh][[*STATUS.names, "late"]]
    state.update(tuple(seen.get_level_values(at).to_numpy(dtype=np.int64).tobytes() for at in (0, 1)))


def first_seen(rows: DataFrame, watermark: str = WATERMARK, shares: int | None = None) -> DataFrame:
    """Streaming status rows without repeated keys, and ``late``.

    The keys that the watermark has not passed live in the state store, dealt by a hash of the whole key and by day, so
    that neither a busy station nor a busy day is one group; ``SLOTS`` days take turns, so that old keys go when a later day comes.
    Rows behind the watermark, and rows whose key is not whole, pass with ``late`` set: they are to be compared with what is stored.
    """
    shares = shares or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    us = micros("fetched_at")
    keyed = rows.select(
        *[F.col(f.name).cast("string").alias(f.name) for f in STATUS.fields],  # text passes through pandas unchanged, NULL or not
        F.coalesce("station_id", F.lit(0)).alias("station"), F.coalesce(us, F.lit(0)).alias("micros"),
        (F.col("station_id").isNull() | F.col("fetched_at").isNull()).alias("unkeyed"), F.timestamp_micros(us).alias("instant"),
        F.coalesce(F.pmod(F.floor(us / DAY), F.lit(SLOTS)), F.lit(0)).cast("int").alias("slot"),
        F.pmod(F.xxhash64("station_id", "fetched_at"), F.lit(shares)).alias("share"),
    ).withWatermark("instant", watermark)
    texts = T.StructType([*(T.StructField(name, T.StringType()) for name in STATUS.names), T.StructField("late", T.BooleanType())])
    found = keyed.groupBy("slot", "share").applyInPandasWithState(
        _first_seen, texts, "stations binary, times binary", "append", GroupStateTimeout.NoTimeout)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATUS.fields], "late")


def _unknown(rows: DataFrame, dest: str) -> DataFrame:
    """The rows, one per key, whose key the destination does not hold in the rows' own dates."""
    dates = [row["date"] for row in rows.select("date").distinct().collect()]  # bounded by the calendar
    inside = reduce(or_, [F.col("date").eqNullSafe(F.lit(day).cast("date")) for day in dates], F.lit(False))
    held = rows.sparkSession.read.schema(STATUS).parquet(dest).where(inside)
    held = held.select(*[F.col(name).alias(f"held_{name}") for name in KEY])
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"held_{name}")) for name in KEY])
    return rows.dropDuplicates(KEY).join(held, same, "left_anti")


class _Store:
    """Appends batches of ``first_seen`` to the destination.

    Only a run's first batch can be one that an earlier run has begun to store; it is compared with its dates.  So is every batch of
    a run whose state is new while the destination is not (``whole``).  Late rows always are: they go to the side table, a folder
    per batch that a repeated batch replaces, and from there those that are new to the destination.
    """

    def __init__(self, dest: str, side: str, whole: bool):
        self.dest, self.side, self.whole, self.compare = dest, side, whole, True

    def append(self, rows: DataFrame) -> None:
        rows.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(self.dest)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{self.side}/batch={number}"
        batch = batch.persist()
        try:
            on_time = batch.where(~F.col("late")).drop("late")
            if not on_time.isEmpty():
                self.append(_unknown(on_time, self.dest) if self.compare else on_time)
            late = batch.where("late").drop("late")
            if not late.isEmpty():
                late.write.mode("overwrite").parquet(folder)
                self.append(_unknown(spark.read.schema(STATUS).parquet(folder), self.dest))
            self.compare = self.whole
        finally:
            batch.unpersist()


def late_rows(spark: SparkSession, dest: str) -> DataFrame:
    """The rows that came behind the watermark, with the batch that brought them; repeated and known ones too."""
    schema = T.StructType([*STATUS.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(side_of(located(dest)))
    except AnalysisException:  # none came yet
        return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def side_of(dest: str) -> str:
    return f"{dest.rstrip('/')}-late"


def ingest_stream(spark: SparkSession, landing: str, dest: str, checkpoint: str,
                  schema: T.StructType = ENVELOPE, *, multiline: bool | None = None,
                  max_files: int | None = None, watermark: str = WATERMARK) -> StreamingQuery:
    """Start one run over the files not ingested yet and stop when they are done.

    Rows are unique by (station_id, fetched_at).  Keys of the last ``watermark`` of the feed are known to the state, which the
    checkpoint keeps between runs; nothing stored is read for them, so one checkpoint is to feed one destination.  Rows that come later still are kept in a side table
    (:func:`late_rows`) and stored if the destination lacks them, so a row is kept however late it comes.
    """
    landing, dest, checkpoint = located(landing), located(dest), located(checkpoint)
    rows = first_seen(read_landing(spark, landing, schema, multiline=multiline, max_files=max_files), watermark)
    whole = not _exists(spark, f"{checkpoint.rstrip('/')}/metadata") and _exists(spark, dest)
    # an empty append makes the folder, so that the first batch can look into it
    spark.createDataFrame([], STATUS).write.mode("append").partitionBy("date").parquet(dest)
    provider = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # keys on local disk, not in the executors' heap; a query keeps what holds at its start
    try:
        return (rows.writeStream.foreachBatch(_Store(dest, side_of(dest), whole)).outputMode("append")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, provider)
