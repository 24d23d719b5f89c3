"""Snapshot readers by file extension."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.session import located
from snapgrid.sources.delimited import infer_csv
from snapgrid.sources.documents import inferred, parsed, read_documents
from snapgrid.sources.drift import read_drifted

# The reader each extension is given to.
FORMATS = {
    ".parquet": "parquet",
    ".json": "json",
    ".gz": "json",
    ".csv": "csv",
    ".ndjson": "json",
}


class UnsupportedFormat(ValueError):
    """The extension has no reader."""


def extension(path: str) -> str:
    return os.path.splitext(path.replace("*", "x"))[1]


def split_pattern(path: str) -> tuple[str, str | None]:
    """``root/**/*.ext`` as its root and a file-name pattern; other paths unchanged."""
    if "**" not in path:
        return path, None
    root, rest = path.split("**", 1)
    return root.rstrip("/") or "/", rest.strip("/") or None


def _hive_partitioned(spark: SparkSession, root: str) -> bool:
    try:
        spark.read.format("binaryFile").load(f"{root}/date=*")
    except AnalysisException:
        return False
    return True


def _day_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/date=(\d{4}-\d{2}-\d{2})/", 1), F.lit("")).cast("date")


def read_snapshots(spark: SparkSession, path: str | Sequence[str], ext: str | None = None, *,
                   schema: T.StructType | None = None, start: str | None = None, end: str | None = None,
                   multiline: bool | None = None, provenance: bool = False, tolerance: float = 0.0) -> DataFrame:
    """Snapshot files below a folder, one file, or a glob (``**`` is recursive).

    The extension picks the reader unless ``ext`` names it.  Parquet files are
    united by column name.  ``start`` and ``end`` (inclusive dates) prune
    ``date=`` folders.  ``multiline`` says whether a JSON document spans lines;
    None reads files of any layout, each as one text, which is cut into its
    documents (``.ndjson`` files have one per line).  ``provenance`` adds the
    source path as ``filename``.  Without ``schema`` it is inferred from all
    values of CSV files and JSON documents of any layout, which are read once
    and kept in the scratch folder; ``tolerance`` is the share of a CSV column's
    values that may not fit its type (see :mod:`snapgrid.sources.delimited`).
    """
    paths = [located(p) for p in ([path] if isinstance(path, str) else path)]
    ext = ext or extension(paths[0])
    if ext not in FORMATS:
        raise UnsupportedFormat(f"no reader for {ext or 'a path without extension'!r}: {paths[0]}")
    fmt = FORMATS[ext]

    options: dict[str, str] = {}
    partition_from_path = False
    if len(paths) == 1:
        root, pattern = split_pattern(paths[0])
        paths = [root]
        if pattern:
            options["pathGlobFilter"] = pattern.rsplit("/", 1)[-1]
            if not _hive_partitioned(spark, root):
                options["recursiveFileLookup"] = "true"
                partition_from_path = True

    reader = spark.read.format(fmt).options(**options)
    if fmt == "json" and multiline is None and ext != ".ndjson":
        found = read_documents(spark, paths, options)
        df = inferred(found) if schema is None else parsed(found, schema)
        if partition_from_path and "date" not in df.columns and (start or end):
            df = df.withColumn("date", _day_of(F.col("filename")))
        return between_dates(df if provenance else df.drop("filename"), start, end)
    if fmt == "json":
        reader = reader.option("multiLine", bool(multiline)).option("mode", "FAILFAST")
    elif fmt == "csv":
        reader = reader.option("header", True)

    if schema is not None:
        df = reader.schema(schema).load(paths)
    elif fmt == "parquet":
        try:
            df = reader.option("mergeSchema", True).load(paths)
        except Exception as error:  # raised by the footer-reading job as a Spark error, not an analysis one
            if "CANNOT_MERGE_SCHEMAS" not in str(error) and "CANNOT_MERGE_INCOMPATIBLE" not in str(error):
                raise
            df = read_drifted(spark, paths, options, provenance)
            provenance = False
    elif fmt == "csv":
        df = infer_csv(spark, paths, options, tolerance, provenance or partition_from_path)
        if partition_from_path and "date" not in df.columns and (start or end):
            df = df.withColumn("date", _day_of(F.col("filename")))
        return between_dates(df if provenance or "filename" not in df.columns else df.drop("filename"), start, end)
    else:
        df = reader.load(paths)

    if provenance:
        df = df.withColumn("filename", F.col("_metadata.file_path"))
    if partition_from_path and "date" not in df.columns and (start or end):
        df = df.withColumn("date", _day_of(F.col("_metadata.file_path")))
    return between_dates(df, start, end)


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep rows of an inclusive date range, by partition column where there is one."""
    if not (start or end):
        return df
    day = F.col("date") if "date" in df.columns else F.to_date("fetched_at")
    if start:
        df = df.where(day >= F.lit(start).cast("date"))
    if end:
        df = df.where(day <= F.lit(end).cast("date"))
    return df

