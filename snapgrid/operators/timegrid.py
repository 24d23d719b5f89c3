"""Observations projected onto a regular grid of time steps per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.functions.numbers import percent
from snapgrid.functions.time import HOUR, MINUTE, floor_to, from_micros, micros
from snapgrid.operators.latest import latest_per_bucket


def aligned(step_min: int) -> bool:
    """Whether every bucket lies on a grid that starts at a full hour."""
    return 60 % step_min == 0


def grid_bounds(status: DataFrame, step_min: int = 15) -> DataFrame:
    """One row: grid start ``t0`` (microseconds) and number of steps.

    The grid runs from the hour of the first observation to the last one.
    """
    if step_min <= 0:
        raise ValueError("step_min must be positive")
    start = floor_to(micros("debut"), HOUR)
    steps = F.floor((micros("fin") - F.col("t0")) / F.lit(step_min * MINUTE)) + 1
    return (
        status.agg(F.min("fetched_at").alias("debut"), F.max("fetched_at").alias("fin"))
        .select("fin", start.alias("t0")).select("t0", steps.cast("bigint").alias("n_steps"))
    )


def on_grid(cells: DataFrame, status: DataFrame, step_min: int) -> DataFrame:
    """Keep the buckets that coincide with a grid cell; all do for a step that divides the hour."""
    if aligned(step_min):
        return cells
    width = F.lit(step_min * MINUTE)
    offset = micros("ts") - F.col("t0")
    return (
        cells.crossJoin(F.broadcast(grid_bounds(status, step_min)))
        .where((F.pmod(offset, width) == 0) & (offset >= 0) & (offset < F.col("n_steps") * width))
        .drop("t0", "n_steps")
    )


def observed_buckets(status: DataFrame, step_min: int = 15, value: str = "num_bikes_available") -> DataFrame:
    """Latest observation per bucket with its place on the grid.

    ``cell`` is the first grid cell at or after the bucket; ``n_bikes`` is kept
    only if the bucket is that cell.  ``t0`` and ``n_steps`` describe the grid.
    A NULL station is on the grid and never observed; a row without a time has no cell.
    """
    width = F.lit(step_min * MINUTE)
    offset = micros("ts") - F.col("t0")
    rest = F.pmod(offset, width)
    cell = ((offset - rest) / width).cast("bigint") + F.when(rest == 0, 0).otherwise(1)
    return (
        latest_per_bucket(status, step_min, value)
        .crossJoin(F.broadcast(grid_bounds(status, step_min)))
        .select("station_id", "t0", "n_steps", cell.alias("cell"),
                F.when((rest == 0) & F.col("station_id").isNotNull(), F.col("n_bikes")).alias("n_bikes"))
    )


def fill_cells(observed: DataFrame, step_min: int, values: Sequence[str]) -> DataFrame:
    """``(station_id, ts, us, cell, n_steps, *values)`` for every cell of every station.

    ``us`` is ``ts`` in microseconds.
    ``observed`` has ``(station_id, t0, n_steps, cell, *values)``.  Each of its
    cells emits itself and the empty cells up to the station's next one, so
    neither a scaffold nor a join is built; the first one also emits the empty
    cells before it.  Rows on the same cell are merged; rows without a cell
    count only where a station has no others, and then emit all its cells
    once.  The window sees at most a few rows per station and step.
    """
    per_station = Window.partitionBy("station_id").orderBy("cell")
    same_cell = per_station.rangeBetween(0, 0)
    first = F.lag("cell").over(per_station).isNull()
    following = F.coalesce(F.lead("cell").over(per_station), F.col("n_steps"))
    # NULL cells come first, so the last row has one only if all have
    stands = F.col("cell").isNotNull() | F.lead(F.lit(1)).over(per_station).isNull()
    spans = observed.select(
        "station_id", "t0", "n_steps", F.col("cell").alias("own"),
        F.when(first, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("cell"))).alias("low"),
        F.when(stands, F.least(following, F.col("n_steps"))).alias("high"),
        *[F.max(v).over(same_cell).alias(v) for v in values],
    ).where("low < high")
    width = F.lit(step_min * MINUTE)
    start = F.col("t0") + F.col("cell") * width
    return (
        spans.select("station_id", "t0", "n_steps", "own", *values,
                     F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("cell"))
        .select("station_id", from_micros(start).alias("ts"), start.alias("us"), "cell", "n_steps",
                *[F.when(F.col("cell") == F.col("own"), F.col(v)).alias(v) for v in values])
    )


def grid(status: DataFrame, step_min: int = 15, value: str = "num_bikes_available") -> DataFrame:
    """``(station_id, ts, n_bikes, is_imputed)``: every station at every step of the history.

    An empty cell, or one whose last observation has a NULL value, is imputed.
    """
    cells = fill_cells(observed_buckets(status, step_min, value), step_min, ["n_bikes"])
    return cells.select("station_id", "ts", "n_bikes", F.col("n_bikes").isNull().alias("is_imputed"))


def observed_cells(status: DataFrame, step_min: int = 15, value: str = "num_bikes_available") -> DataFrame:
    """Per station the number of grid cells that hold a value; stations without one, and the NULL station, get 0."""
    return observed_cells_of(latest_per_bucket(status, step_min, value), status, step_min)


def observed_cells_of(latest: DataFrame, runs: DataFrame, step_min: int = 15) -> DataFrame:
    """The same from (station_id, ts, n_bikes) of each bucket; ``runs`` has every ``fetched_at``, or the first and the last."""
    held = latest.withColumn("n_bikes", F.when(F.col("station_id").isNotNull(), F.col("n_bikes")))
    if aligned(step_min):
        return held.groupBy("station_id").agg(F.count("n_bikes").alias("remplies"))
    width = F.lit(step_min * MINUTE)
    offset = micros("ts") - F.col("t0")
    inside = (F.pmod(offset, width) == 0) & (offset >= 0) & (offset < F.col("n_steps") * width)
    return (
        held.crossJoin(F.broadcast(grid_bounds(runs, step_min)))
        .groupBy("station_id").agg(F.count(F.when(inside, F.col("n_bikes"))).alias("remplies"))
    )


def fill_rate(status: DataFrame, step_min: int = 15, value: str = "num_bikes_available") -> DataFrame:
    """Number of grid cells and the percentage observed, counted without building the grid."""
    return fill_rate_of(latest_per_bucket(status, step_min, value), status, step_min)


def fill_rate_of(latest: DataFrame, runs: DataFrame, step_min: int = 15) -> DataFrame:
    """The same from (station_id, ts, n_bikes) of each bucket and rows with the first and last ``fetched_at``."""
    totals = observed_cells_of(latest, runs, step_min).agg(
        F.count("*").alias("stations"), F.coalesce(F.sum("remplies"), F.lit(0)).alias("remplies"))
    cells = F.coalesce(F.col("stations") * F.col("n_steps"), F.lit(0)).alias("cases")
    return (
        totals.crossJoin(F.broadcast(grid_bounds(runs, step_min)))
        .select(cells, "remplies")
        .select("cases", percent(F.col("remplies"), F.col("cases"), 2).alias("pct_remplies"))
    )


def worst_holes(status: DataFrame, step_min: int = 15, k: int = 5, value: str = "num_bikes_available") -> DataFrame:
    """The ``k`` stations with the largest share of empty cells; ties by station."""
    holes = percent(F.col("n_steps") - F.col("remplies"), F.col("n_steps"), 1).alias("pct_trous")
    return (
        observed_cells(status, step_min, value)
        .crossJoin(F.broadcast(grid_bounds(status, step_min)))
        .select("station_id", holes)
        .orderBy(F.desc_nulls_last("pct_trous"), F.asc_nulls_last("station_id")).limit(k)
    )
