"""Runs of an unchanged value per station (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.functions.time import floor_to, interval_micros, minute_number, seconds
from snapgrid.operators.freshness import report_age


def _hours(interval: Column) -> Column:
    return seconds(interval_micros(interval)) / 3600.0


def _slice_islands(status: DataFrame, value: str, slice_min: int, unique: bool) -> DataFrame:
    """Islands inside each (station, time slice), flagged when they touch its ends."""
    observations = (
        status.where(F.col(value).isNotNull() & F.col("fetched_at").isNotNull())
        .select("station_id", F.col("fetched_at").alias("t"), F.col(value).alias("b"), report_age().alias("age"))
    )
    if unique:
        observations = observations.withColumn("n_obs", F.lit(1))
    else:  # copies of an observation are combined before they reach a window
        observations = observations.groupBy("station_id", "t", "b").agg(
            F.count("*").alias("n_obs"), F.max("age").alias("age"))
    observations = observations.withColumn("slice", floor_to(minute_number("t"), slice_min))
    chain = Window.partitionBy("station_id", "slice").orderBy("t", "b")
    # rows at one instant are peers: they get the same running sum
    peers = Window.partitionBy("station_id", "slice").orderBy("t")
    marked = (
        observations
        .withColumn("before", F.lag("b").over(chain))
        .withColumn("opens", F.col("before").isNull())
        .withColumn("closes", F.lead("b").over(chain).isNull())
        .withColumn("local", F.sum(F.when(F.col("b").eqNullSafe(F.col("before")), 0).otherwise(1)).over(peers))
    )
    return marked.groupBy("station_id", "slice", "local").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.min("b").alias("valeur"),
        F.max(F.when(F.col("closes"), F.col("b"))).alias("last_b"),
        F.sum("n_obs").alias("n_obs"), F.max("age").alias("age"),
        F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"),
    )


def islands(status: DataFrame, value: str = "num_bikes_available", slice_min: int = 10,
            min_hours: float | None = None, unique: bool = False) -> DataFrame:
    """One row per island: station_id, valeur, n_obs, debut, fin, duree_h, fraicheur_max_h.

    NULL values are dropped first, so an island bridges them.  A station's
    timeline is cut into slices; islands are found per slice and only those
    touching a slice's ends are stitched, at most two rows per slice.  A
    station with a third of all rows is therefore spread over its slices, and
    a slice holds no more than its distinct instants.
    ``min_hours`` keeps islands at least that long; those strictly inside a
    shorter slice are then dropped before the second shuffle.  ``unique`` skips
    the shuffle that combines copies, for a history without any.
    """
    local = _slice_islands(status, value, slice_min, unique)
    touching = F.col("opens") | F.col("closes")
    if min_hours is not None and slice_min <= min_hours * 60:
        local = local.where(touching)

    # Inner islands stay in a group of their own slice, the others meet per station.
    # An opening island continues the one before, unless a second value at its first
    # instant already moved it on (local > 1); without one its value is constant.
    chain = Window.partitionBy("station_id", "inner_slice").orderBy("first")
    continues = F.col("opens") & (F.col("local") == 1) & F.col("valeur").eqNullSafe(F.lag("last_b").over(chain))
    stitched = (
        local.withColumn("inner_slice", F.when(~touching, F.col("slice")))
        .withColumn("starts", F.when(continues, 0).otherwise(1))
        .withColumn("island", F.sum("starts").over(chain))
        .groupBy("station_id", "inner_slice", "island")
        .agg(F.min("first").alias("debut"), F.max("last").alias("fin"), F.min("valeur").alias("valeur"),
             F.sum("n_obs").alias("n_obs"), F.max("age").alias("age"))
    )
    result = stitched.select(
        "station_id", "valeur", "n_obs", "debut", "fin",
        _hours(F.col("fin") - F.col("debut")).alias("duree_h"),
        _hours(F.col("age")).alias("fraicheur_max_h"),
    )
    return result if min_hours is None else result.where(F.col("duree_h") >= float(min_hours))


def frozen(status: DataFrame, value: str = "num_bikes_available", thresholds_h: Sequence[int] = (3, 6, 12, 24),
           confirm_h: int = 6, slice_min: int = 10, unique: bool = False) -> DataFrame:
    """Per threshold: islands at least that long, their stations, and how many have stale reports.

    Thresholds are cumulative; one that no island reaches gives no row.
    """
    long_enough = islands(status, value, slice_min, min(thresholds_h), unique)
    threshold = F.explode(F.array(*[F.lit(h) for h in thresholds_h])).alias("seuil_heures")
    return (
        long_enough.select("station_id", "duree_h", "fraicheur_max_h", threshold)
        .where("duree_h >= seuil_heures")
        .groupBy("seuil_heures").agg(
            F.count("*").alias("n_plages"),
            F.count_distinct("station_id").alias("n_stations"),
            F.count_if(F.col("fraicheur_max_h") > confirm_h).alias("dont_fraicheur_confirme"),
        ).orderBy("seuil_heures")
    )


def frozen_agreement(thresholds: DataFrame, at_h: int = 6) -> DataFrame:
    """Share of confirmed islands at one threshold; no row when that threshold has none."""
    share = (F.col("dont_fraicheur_confirme") / F.col("n_plages")).alias("accord")
    return thresholds.where(F.col("seuil_heures") == at_h).select("n_stations", share)
