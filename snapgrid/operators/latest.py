"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.functions.time import bucket


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str = "fetched_at",
                   ties: Sequence[str] = ()) -> DataFrame:
    """Whole row with the greatest ``order`` (then ``ties``) for each key.

    Catalyst puts a group limit before the shuffle, so a hot key sends one row
    per task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in (order, *ties)])
    return df.withColumn("_rank", F.row_number().over(newest_first)).where("_rank = 1").drop("_rank")


def latest_reference(info: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Latest reference snapshot of each station."""
    return latest_per_key(info, ["station_id"], "fetched_at", ties)


def latest_per_bucket(status: DataFrame, step_min: int = 15, value: str = "num_bikes_available",
                      tie_break: bool = False) -> DataFrame:
    """``(station_id, ts, n_bikes)``: last observation in each time bucket, NULL value included.

    Rows without a time share the bucket NULL, with the value NULL, so that their stations are not lost.

    A hash aggregation combined map-side, so copies and hot buckets shrink
    before the shuffle.  Which of several different values at one instant
    counts is open, unless ``tie_break`` takes the greatest; that sorts all
    rows and takes about twice as long.
    """
    known = F.when(F.col("fetched_at").isNotNull(), F.col(value))
    seen = status.select(
        "station_id", bucket("fetched_at", step_min).alias("ts"), "fetched_at", known.alias("n_bikes"))
    if tie_break:
        return latest_per_key(seen, ["station_id", "ts"], "fetched_at", ["n_bikes"]).drop("fetched_at")
    return seen.groupBy("station_id", "ts").agg(F.max_by("n_bikes", "fetched_at").alias("n_bikes"))
