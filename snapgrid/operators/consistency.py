"""Counts of implausible values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.operators.latest import latest_reference

COUNTS = ["n", "nulls_bikes", "types_incoherents", "negatifs", "depasse_capacite",
          "hors_service", "non_installees"]


def checks() -> list[Column]:
    """The counts that a row alone decides."""
    return [
        F.count("*").alias("n"),
        F.count_if(F.col("num_bikes_available").isNull()).alias("nulls_bikes"),
        F.count_if(F.col("mechanical") + F.col("ebike") != F.col("num_bikes_available")).alias("types_incoherents"),
        F.count_if((F.col("num_bikes_available") < 0) | (F.col("num_docks_available") < 0)).alias("negatifs"),
        F.count_if(~F.col("is_renting")).alias("hors_service"),
        F.count_if(~F.col("is_installed")).alias("non_installees"),
    ]


def consistency(status: DataFrame, info: DataFrame | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """One row of counts; a comparison with NULL does not count.

    Without a reference table ``depasse_capacite`` is NULL.  With one, status
    is first reduced to one row per (station, bikes + docks), so the join sees
    that table only: a hot station is already combined, and AQE is free to
    broadcast or sort-merge by the real sizes.
    """
    if info is None:
        return status.agg(*checks()).withColumn("depasse_capacite", F.lit(None).cast("bigint")).select(COUNTS)
    slots = (F.col("num_bikes_available") + F.col("num_docks_available")).alias("places")
    return consistency_of(status.groupBy("station_id", slots).agg(*checks()), info, ties)


def consistency_of(reduced: DataFrame, info: DataFrame | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The same from (station_id, places, counts...), in any number of rows per station and places."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS if c != "depasse_capacite"]
    if info is None:
        return reduced.agg(*sums).withColumn("depasse_capacite", F.lit(None).cast("bigint")).select(COUNTS)
    capacity = latest_reference(info, ties).select("station_id", "capacity")
    over = F.when(F.col("places") > F.col("capacity"), F.col("n")).otherwise(F.lit(0)).alias("depasse_capacite")
    joined = reduced.join(capacity, "station_id", "left").select("*", over)
    return joined.agg(*sums, F.coalesce(F.sum("depasse_capacite"), F.lit(0)).alias("depasse_capacite")).select(COUNTS)
