"""Lead-based target and the persistence baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.functions.numbers import ratio, round_to
from snapgrid.functions.time import MINUTE, local_hour, micros
from snapgrid.operators.latest import latest_per_bucket
from snapgrid.operators.timegrid import fill_cells, observed_buckets, on_grid

# Local-time slots as (first hour, last hour, label); later hours get the last label.
SLOTS = [
    (0, 5, "00-06 nuit"),
    (6, 9, "06-10 pointe matin"),
    (10, 15, "10-16 journée"),
    (16, 19, "16-20 pointe soir"),
]
LAST_SLOT = "20-24 soirée"


def horizon_cells(step_min: int, horizon_min: int = 60) -> int:
    """Whole steps in the horizon; where it is no multiple of the step, the real horizon is that many steps, and shorter."""
    if step_min <= 0 or horizon_min < step_min:
        raise ValueError(f"a horizon of {horizon_min} minutes has no step of {step_min}")
    return horizon_min // step_min


def target(status: DataFrame, step_min: int = 15, horizon_min: int = 60, tz: str = "Europe/Paris",
           value: str = "num_bikes_available") -> DataFrame:
    """Every grid cell with the value one horizon later and its local hour.

    The last cells of a station have no later one: ``y`` and ``y_imputed`` are NULL.
    Each observation also stands, as ``y``, on the cell one horizon before it,
    so the later value is in place before the empty cells are filled in.
    """
    ahead = horizon_cells(step_min, horizon_min)
    nothing = F.lit(None)
    own = F.struct(F.col("cell"), F.col("n_bikes"), nothing.alias("y"))
    earlier = F.struct((F.col("cell") - ahead).alias("cell"), nothing.alias("n_bikes"), F.col("n_bikes").alias("y"))
    both = observed_buckets(status, step_min, value).select(
        "station_id", "t0", "n_steps", F.inline(F.array(own, earlier)))
    return fill_cells(both, step_min, ["n_bikes", "y"]).select(
        "station_id", "ts", "n_bikes", F.col("n_bikes").isNull().alias("is_imputed"), "y",
        F.when(F.col("cell") + ahead < F.col("n_steps"), F.col("y").isNull()).alias("y_imputed"),
        local_hour("us", tz).alias("h_paris"),
    )


def observed_pairs(cells: DataFrame) -> DataFrame:
    """Cells of :func:`target` whose value and later value were both observed."""
    return cells.where(~F.col("is_imputed") & ~F.col("y_imputed") & F.col("y").isNotNull())


def target_pairs(status: DataFrame, step_min: int = 15, horizon_min: int = 60, tz: str = "Europe/Paris",
                 value: str = "num_bikes_available") -> DataFrame:
    """Same rows as ``observed_pairs(target(...))`` without building empty cells.

    A window range of exactly one horizon looks the later cell up.  Its groups
    hold at most one row per station and step.
    """
    return target_pairs_of(latest_per_bucket(status, step_min, value), status, step_min, horizon_min, tz)


def target_pairs_of(latest: DataFrame, runs: DataFrame, step_min: int = 15, horizon_min: int = 60,
                    tz: str = "Europe/Paris") -> DataFrame:
    """The same from (station_id, ts, n_bikes) of each bucket; ``runs`` has every ``fetched_at``, or the first and the last."""
    ahead = horizon_cells(step_min, horizon_min) * step_min * MINUTE
    later = Window.partitionBy("station_id").orderBy("us").rangeBetween(ahead, ahead)
    held = on_grid(latest, runs, step_min)
    return (
        held.where("n_bikes IS NOT NULL AND station_id IS NOT NULL")
        .withColumn("us", micros("ts"))
        .withColumn("y", F.max("n_bikes").over(later))
        .where("y IS NOT NULL")
        .select("station_id", "ts", "n_bikes", F.lit(False).alias("is_imputed"),
                "y", F.lit(False).alias("y_imputed"), local_hour("us", tz).alias("h_paris"))
    )


def slot(hour: Column, slots: Sequence[tuple[int, int, str]] = SLOTS, rest: str = LAST_SLOT) -> Column:
    """Label of the local-time slot holding an hour of day."""
    (low, high, label), *others = slots
    chosen = F.when(hour.between(low, high), label)
    for low, high, label in others:
        chosen = chosen.when(hour.between(low, high), label)
    return chosen.otherwise(rest)


def slot_errors(pairs: DataFrame) -> DataFrame:
    """``(creneau, n, erreur)``: pairs and summed absolute error per local-time slot.

    The error is that of "the value stays as it is"; a slot is the origin cell's.
    """
    return pairs.groupBy(slot(F.col("h_paris")).alias("creneau")).agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("n_bikes") - F.col("y"))).alias("erreur"))


def mae_of(errors: DataFrame) -> DataFrame:
    """Mean absolute error over all slots, one row."""
    return errors.agg(round_to(ratio(F.sum("erreur"), F.sum("n")), 3).alias("mae"))


def mae_of_slots(errors: DataFrame) -> DataFrame:
    """Mean absolute error of each slot."""
    return errors.select("creneau", "n", round_to(ratio(F.col("erreur"), F.col("n")), 3).alias("mae"))


def persistence_mae(pairs: DataFrame) -> DataFrame:
    """Mean absolute error of the persistence baseline, one row."""
    return mae_of(slot_errors(pairs))


def persistence_mae_by_slot(pairs: DataFrame) -> DataFrame:
    """The same error per local-time slot."""
    return mae_of_slots(slot_errors(pairs)).orderBy("creneau")
