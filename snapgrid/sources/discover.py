"""What files lie below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.session import located
from snapgrid.sources.readers import FORMATS, split_pattern


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of every file with a known extension; no content is read."""
    root, _ = split_pattern(located(root))
    known = ",".join(ext.lstrip(".") for ext in FORMATS)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{known}}}")
        .load(root).select("path", "length")
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, ext, n_files, bytes)`` per dataset folder and extension.

    A dataset is the folder above the first ``date=`` part, relative to
    ``root``; files directly in the root, or in its own ``date=`` folders,
    form the dataset ``"."``.
    """
    base = split_pattern(located(root))[0].rstrip("/")
    base = base.split(":", 1)[1] if base.startswith("file:") else base
    at = F.locate(base + "/", F.col("path"))
    inside = F.when(at > 0, F.substr(F.col("path"), at + F.lit(len(base) + 1))).otherwise(
        F.regexp_extract("path", r"([^/]+)$", 1))
    folder = F.regexp_replace(inside, r"/?[^/]*$", "")
    dataset = F.regexp_replace(folder, r"(^|/)date=.*$", "")
    return (
        list_files(spark, root)
        .select(F.coalesce(F.nullif(dataset, F.lit("")), F.lit(".")).alias("dataset"),
                F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ext"), "length")
        .groupBy("dataset", "ext").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    )
