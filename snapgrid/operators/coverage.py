"""Volume, collection cadence and stability of the set of stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.functions.numbers import round_to
from snapgrid.functions.sketches import instants_sketch, keys_sketch
from snapgrid.functions.time import DAY, MINUTE, floor_to, from_micros, micros, seconds


def volume(status: DataFrame, step_min: int = 15, accuracy: float | None = None) -> DataFrame:
    """One row: rows, distinct runs and stations, period, and the collection rate.

    The two distinct counts are two narrow aggregations instead of one that
    would first copy every row per distinct column.  ``accuracy`` estimates both
    to that relative standard error, in one scan without a shuffle of keys.
    """
    if accuracy is not None:
        return rated(status.agg(
            F.count("*").alias("n_lignes"), F.hll_sketch_estimate(instants_sketch("fetched_at", accuracy)).alias("n_runs"),
            F.min("fetched_at").alias("debut"), F.max("fetched_at").alias("fin"),
            F.hll_sketch_estimate(keys_sketch("station_id", accuracy)).alias("n_stations")), step_min)
    return volume_of(status.groupBy("fetched_at").agg(F.count("*").alias("n")), status, step_min)


def volume_of(by_run: DataFrame, stations: DataFrame, step_min: int = 15) -> DataFrame:
    """The same from (fetched_at, n), a row per run, and rows with every ``station_id``."""
    runs = by_run.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_lignes"),
        F.count("fetched_at").alias("n_runs"),
        F.min("fetched_at").alias("debut"),
        F.max("fetched_at").alias("fin"),
    )
    stations = stations.select("station_id").distinct().agg(F.count("station_id").alias("n_stations"))
    return rated(runs.crossJoin(F.broadcast(stations)), step_min)


def rated(counts: DataFrame, step_min: int) -> DataFrame:
    """The counts and the period with its length and the collection rate."""
    days = seconds(micros("fin") - micros("debut")) / 86400.0
    expected = F.col("jours") * 24.0 * 60.0 / float(step_min)
    return (
        counts.withColumn("jours", days)
        .withColumn("runs_attendus", expected)
        .withColumn("taux_collecte", F.when(F.col("runs_attendus") == 0, F.lit(0.0))
                    .otherwise(F.try_divide(F.col("n_runs").cast("double"), F.col("runs_attendus"))))
        .select("n_lignes", "n_runs", "n_stations", "debut", "fin", "jours", "runs_attendus", "taux_collecte")
    )


def _edge_gaps(instants: DataFrame, within: int | None, part: int) -> DataFrame:
    """Gaps between one non-empty ``part`` slice and the next inside a ``within`` slice."""
    edges = instants.groupBy(floor_to("t", part).alias("part")).agg(F.min("t").alias("t"), F.max("t").alias("last"))
    order = Window.orderBy("part") if within is None else \
        Window.partitionBy(floor_to("part", within)).orderBy("part")
    return edges.select("t", (F.col("t") - F.lag("last").over(order)).alias("gap"))


def run_gaps(status: DataFrame) -> DataFrame:
    """``(jour, gap, n)``: how often each gap (microseconds) precedes a run of a day.

    A gap belongs to the day of its later run; the first run has a NULL gap.
    Rows without a time are one run of the day NULL, with a NULL gap.
    The chain of runs is never ordered in one task: gaps come from inside each
    minute, then between the minutes of a day (at most 1440 rows), then between
    days (one row per day, the only unpartitioned window).  All three read the
    same shuffle of distinct instants.
    """
    instants = status.select("fetched_at").distinct().select(micros("fetched_at").alias("t"))
    minute = Window.partitionBy(floor_to("t", MINUTE)).orderBy("t")
    inner = instants.select("t", (F.col("t") - F.lag("t").over(minute)).alias("gap")).where("gap IS NOT NULL")
    between_minutes = _edge_gaps(instants, DAY, MINUTE).where("gap IS NOT NULL")
    between_days = _edge_gaps(instants, None, DAY)
    return (
        inner.unionByName(between_minutes).unionByName(between_days)
        .groupBy(floor_to("t", DAY).alias("day"), "gap").agg(F.count("*").alias("n"))
        .select(from_micros("day").cast("date").alias("jour"), "gap", "n")
    )


def _minutes(us: Column) -> Column:
    return round_to(seconds(us) / 60.0, 1)


def cadence(status: DataFrame, step_min: int = 15, factor: float = 1.5) -> DataFrame:
    """Per day: runs, median and worst gap before a run, gaps above ``factor`` steps.

    The exact median keeps one counter per distinct gap of a day.  Those gaps
    add up to a day, so there are at most about 416,000 of them.
    """
    long_gap = F.col("gap") > F.lit(round(step_min * MINUTE * factor))
    return (
        run_gaps(status).groupBy("jour").agg(
            F.sum("n").alias("runs"),
            _minutes(F.percentile("gap", 0.5, F.col("n"))).alias("ecart_median_min"),
            _minutes(F.max("gap")).alias("pire_trou_min"),
            F.sum(F.when(long_gap, F.col("n")).otherwise(F.lit(0))).alias("runs_manques"),
        ).orderBy(F.asc_nulls_last("jour"))
    )


def cadence_summary(daily: DataFrame) -> DataFrame:
    """Worst gap and total of long gaps over the days of :func:`cadence`."""
    return daily.agg(F.max("pire_trou_min").alias("pire_trou_min"), F.sum("runs_manques").alias("runs_manques"))


def keys_per_day(status: DataFrame, accuracy: float | None = None) -> DataFrame:
    """Distinct stations seen each day; with ``accuracy`` estimated to that relative standard error."""
    stations = F.count_distinct("station_id") if accuracy is None else F.hll_sketch_estimate(keys_sketch("station_id", accuracy))
    return (
        status.groupBy(F.to_date("fetched_at").alias("jour"))
        .agg(stations.alias("n_stations"))
        .orderBy(F.asc_nulls_last("jour"))
    )


def keys_amplitude(daily: DataFrame) -> DataFrame:
    """Richest minus poorest day of :func:`keys_per_day`."""
    return daily.agg((F.max("n_stations") - F.min("n_stations")).alias("amplitude"))


def keys_gone(status: DataFrame, hours: int = 12) -> DataFrame:
    """How many stations were last seen more than ``hours`` before the end of the history."""
    last_seen = status.groupBy("station_id").agg(F.max("fetched_at").alias("vue_le_dernier"))
    end = last_seen.agg(F.max("vue_le_dernier").alias("fin"))
    gone = F.col("vue_le_dernier") < F.col("fin") - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    return last_seen.crossJoin(F.broadcast(end)).where(gone).agg(F.count("*").alias("n_absentes"))
