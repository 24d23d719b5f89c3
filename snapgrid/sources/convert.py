"""Raw feed files to date-partitioned Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.functions.feed import stamp_of
from snapgrid.operators.envelope import flat_status
from snapgrid.session import located
from snapgrid.sources.discover import discover
from snapgrid.sources.readers import FORMATS, read_snapshots
from snapgrid.sources.sinks import rows_below, write_by_date


class EmptyFeed(RuntimeError):
    """A feed listed no station; nothing was written."""


@dataclass(frozen=True)
class Written:
    """Rows of this write, and of everything now at the destination."""

    rows: int
    total: int


def _held(spark: SparkSession, dest: str) -> int:
    try:
        return rows_below(spark, dest)
    except AnalysisException:  # nothing is there
        return 0


def _write(rows: DataFrame, dest: str) -> Written:
    """Replace the dates of the rows.  The input is read once; what the job wrote it has counted itself."""
    seen = Observation("written")
    write_by_date(rows, dest, seen=seen)
    return Written(seen.get["n"], _held(rows.sparkSession, dest))


def _new(rows: DataFrame, dest: str, key: str) -> DataFrame:
    """The rows whose key the destination does not hold yet."""
    try:
        held = rows.sparkSession.read.parquet(dest)
    except AnalysisException:  # nothing is there yet
        return rows
    seen = held.select(F.col(key).alias("held_key")).distinct()
    return rows.join(seen, F.col(key).eqNullSafe(F.col("held_key")), "left_anti")


def convert(spark: SparkSession, src: str, dest: str, ext: str | None = None, *,
            schema: T.StructType | None = None, multiline: bool | None = None,
            bad_stamps: str | None = None) -> Written:
    """Flatten JSON snapshots into canonical rows, partitioned by date.

    Each date that the input holds, even in part, is replaced as a whole.  A file whose name carries no collection stamp fails the job, unless
    ``bad_stamps`` names a folder where its rows are kept instead.
    """
    dest, bad_stamps = located(dest), bad_stamps and located(bad_stamps)
    raw = read_snapshots(spark, src, ext, schema=schema, multiline=multiline, provenance=True)
    if bad_stamps is None or "fetched_at" in raw.columns:
        return _write(flat_status(raw), dest)
    stamped = stamp_of("filename", strict=False).isNotNull()
    _new(raw.where(~stamped), bad_stamps, "filename").write.mode("append").parquet(bad_stamps)
    return _write(flat_status(raw.where(stamped), on_bad_stamp="null"), dest)


def convert_first(spark: SparkSession, root: str, dest: str, **options) -> Written | None:
    """Convert the first JSON dataset below a folder; None when there is none."""
    kinds = [ext for ext, fmt in FORMATS.items() if fmt == "json"]
    found = discover(spark, root).where(F.col("ext").isin(kinds)).orderBy("dataset", "ext").first()
    if found is None:
        return None
    base = root.rstrip("/") if found["dataset"] == "." else f"{root.rstrip('/')}/{found['dataset']}"
    return convert(spark, f"{base}/**/*{found['ext']}", dest, **options)
