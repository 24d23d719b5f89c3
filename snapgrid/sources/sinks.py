"""Writing snapshots and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_by_date(df: DataFrame, dest: str, mode: str = "overwrite", seen: Observation | None = None,
                  whole: bool = False) -> None:
    """Parquet in ``date=`` folders; an overwrite replaces only the dates written, or with ``whole`` all there is.

    The rebalance hint lets AQE split a hot date over several files and merge
    small ones.  ``seen`` gets the number of rows as ``n``.
    """
    rows = df.hint("rebalance", "date")
    if seen is not None:  # above the hint, where a plan that turns out empty is still observed
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode(mode).partitionBy("date").option("partitionOverwriteMode", "static" if whole else "dynamic").parquet(dest)


def _listed(spark: SparkSession, dest: str) -> DataFrame:
    """(day, files, bytes) of each ``date=`` folder below a destination, from the listing; no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load(dest).select("path", "length"))
    day = F.regexp_extract("path", r".*/date=([^/]*)/", 1).alias("day")
    return files.groupBy(day).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def rows_below(spark: SparkSession, dest: str) -> int:
    """Rows of everything stored at a destination.

    What a date holds is counted once, from its footers, and kept in ``_counts`` beside the dates together with the number and
    size of its files; only a date whose files have changed since is counted again.
    """
    counts = f"{dest.rstrip('/')}/_counts"
    listed = _listed(spark, dest)
    try:
        known = spark.read.schema("files bigint, bytes bigint, n bigint, day string").parquet(counts)
    except AnalysisException:  # nothing is counted yet
        known = spark.createDataFrame([], "files bigint, bytes bigint, n bigint, day string")
    judged = listed.join(known, ["day", "files", "bytes"], "left").select("day", "files", "bytes", "n").collect()  # a row per date
    fresh = [row for row in judged if row["n"] is None]
    if fresh:
        base = [f"{dest.rstrip('/')}/date={row['day']}" if row["day"] else dest for row in fresh]
        path = F.regexp_extract(F.col("_metadata.file_path"), r".*/date=([^/]*)/", 1)
        found = spark.read.parquet(*base).groupBy(path.alias("day")).agg(F.count("*").alias("n"))
        found = {row["day"]: row["n"] for row in found.collect()}
        rows = [(row["files"], row["bytes"], found.get(row["day"], 0), row["day"]) for row in fresh]
        (spark.createDataFrame(rows, "files bigint, bytes bigint, n bigint, day string").coalesce(1).write.mode("overwrite")
         .partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(counts))
        return sum(row["n"] or 0 for row in judged) + sum(row[2] for row in rows)
    return sum(row["n"] for row in judged)


def write_report(report: DataFrame, dest: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Store the audit's (section, metric, value, verdict) rows as Parquet, JSON or CSV."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"cannot write a report as {fmt!r}")
    writer = report.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(dest)
