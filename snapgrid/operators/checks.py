"""Invariants that a cleaned history, its stored grid and its stored target should meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.functions.time import MINUTE, from_micros, minute_number
from snapgrid.operators.baseline import horizon_cells
from snapgrid.operators.timegrid import grid_bounds


def duplicate_keys(status: DataFrame) -> DataFrame:
    """Number of (station_id, fetched_at) pairs with more than one row."""
    return (status.groupBy("station_id", "fetched_at").agg(F.count("*").alias("n"))
            .agg(F.count_if(F.col("n") > 1).alias("n_violations")))


def values_out_of_range(status: DataFrame, low: int = 0, high: int = 100,
                        value: str = "num_bikes_available") -> DataFrame:
    """Number of observed values outside ``low``..``high``."""
    return status.agg(F.count_if(~F.col(value).between(low, high)).alias("n_violations"))


def held_steps(cells: DataFrame, step: Column) -> DataFrame:
    """(key, n): how many different steps, numbered from 0, each station of ``cells`` has; a NULL step is none.

    Steps become bits of 64-bit words that are combined before the shuffle, so one row moves for 64 cells, however often a cell is
    there.
    """
    words = (cells.select(F.col("station_id").alias("key"), step.alias("step")).where("step IS NOT NULL")
             .groupBy("key", F.shiftright("step", 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("step", F.lit(64)).cast("int"))).alias("bits")))
    return words.groupBy("key").agg(F.sum(F.bit_count("bits")).alias("n"))


def grid_holes(status: DataFrame, grid: DataFrame, step_min: int = 15) -> DataFrame:
    """Number of cells that the history asks for and ``grid`` lacks.

    ``grid`` has ``(station_id, ts)``.  Each of its cells counts once, however often it is there, and only where it is a
    step of the history; so neither a repeated cell nor a foreign one hides a hole.  The wanted cells are never built:
    every station wants as many as there are steps.
    """
    bounds = grid_bounds(status, step_min).withColumn("start", (F.col("t0") / MINUTE).cast("bigint"))  # a full hour
    bounds = F.broadcast(bounds)  # one row
    offset, width = minute_number("ts") - F.col("start"), F.lit(step_min)
    whole = F.extract(F.lit("SECOND"), F.col("ts")) == 0
    on_step = whole & (F.pmod(offset, width) == 0) & (offset >= 0) & (offset < F.col("n_steps") * width)
    held = held_steps(grid.crossJoin(bounds), F.when(on_step, F.floor(offset / width)))
    stations = status.select("station_id").distinct()
    return (
        stations.join(held, F.col("station_id").eqNullSafe(F.col("key")), "left").crossJoin(bounds)
        .agg(F.coalesce(F.sum(F.col("n_steps") - F.coalesce("n", F.lit(0))), F.lit(0)).alias("n_violations"))
    )


def late_targets(status: DataFrame, target: DataFrame, step_min: int = 15, horizon_min: int = 60) -> DataFrame:
    """Number of rows of ``target``, ``(ts, y)``, with a later value where the history has ended by then."""
    open_from = F.col("t0") + (F.col("n_steps") - horizon_cells(step_min, horizon_min)) * F.lit(step_min * MINUTE)
    bounds = F.broadcast(grid_bounds(status, step_min).select(from_micros(open_from).alias("open_from")))  # one row
    late = (F.col("ts") >= F.col("open_from")) & F.col("y").isNotNull()
    return target.crossJoin(bounds).agg(F.count_if(late).alias("n_violations"))


def dq_checks(status: DataFrame, grid: DataFrame, target: DataFrame, step_min: int = 15, horizon_min: int = 60,
              value: str = "num_bikes_available") -> DataFrame:
    """One row per invariant: check name and number of violations in the given tables."""
    named = {
        "duplicate_key": duplicate_keys(status),
        "value_range": values_out_of_range(status, value=value),
        "grid_hole": grid_holes(status, grid, step_min),
        "late_target": late_targets(status, target, step_min, horizon_min),
    }
    return reduce(DataFrame.unionByName, [
        found.select(F.lit(name).alias("check"), "n_violations") for name, found in named.items()])
