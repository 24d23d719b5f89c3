"""The audit's figures from a state that is kept per day.

One scan of a history makes, for each of its days, what the audit needs of it: its runs, its stations with their places and
counts, its latest value per station and bucket, and its report ages by second.  Days are independent of each other, so a new day costs
that day only, and every figure over any days is a merge of theirs: sums, extremes, and distinct keys that are listed once a day.

``day_sketches`` is the smaller, approximate form: one row a day, with sketches of the distinct runs and stations and of the ages.

The views below give a state the shape of a (much smaller) history, so that the exact operators run on it as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.functions.numbers import percent
from snapgrid.functions.quantiles import upper_second
from snapgrid.functions.sketches import distinct_of, instants_sketch, interval_sketch, keys_sketch, seconds_of
from snapgrid.functions.time import bucket, interval_micros
from snapgrid.operators.consistency import checks
from snapgrid.operators.coverage import rated
from snapgrid.operators.freshness import report_age, rounded
from snapgrid.session import located

RUN, STATION, BUCKET, AGE = "run", "station", "bucket", "age"


def day_state(status: DataFrame, step_min: int = 15, value: str = "num_bikes_available") -> DataFrame:
    """(date, kind, fetched_at, station_id, places, ts, second, n, n_bikes, last_seen, counts...) of every day.

    Four groupings share one scan; rows are combined map-side in each, so only distinct keys are shuffled.  ``kind`` says
    which keys a row has: a run (``fetched_at``), a station with its places, a station's bucket (``ts``), or a second of age.
    """
    rows = status.select(
        F.to_date("fetched_at").alias("date"), "fetched_at", "station_id",
        (F.col("num_bikes_available") + F.col("num_docks_available")).alias("places"), bucket("fetched_at", step_min).alias("ts"),
        upper_second(report_age()).alias("second"), F.col("fetched_at").alias("moment"),
        F.when(F.col("fetched_at").isNotNull(), F.col(value)).alias("seen"),
        "num_bikes_available", "num_docks_available", "mechanical", "ebike", "is_renting", "is_installed")
    sets = {RUN: ["fetched_at"], STATION: ["station_id", "places"], BUCKET: ["station_id", "ts"], AGE: ["second"]}
    keys = ["date", "fetched_at", "station_id", "places", "ts", "second"]
    grouped = rows.groupingSets([[F.col("date"), *map(F.col, names)] for names in sets.values()], *map(F.col, keys)).agg(
        F.grouping_id().alias("missing"), *checks(), F.max_by("seen", "moment").alias("n_bikes"), F.max("moment").alias("last_seen"))
    kind = F.lit(None)
    for name, held in sets.items():
        bits = sum(1 << (len(keys) - 1 - at) for at, key in enumerate(keys) if key != "date" and key not in held)
        kind = F.when(F.col("missing") == bits, F.lit(name)).otherwise(kind)
    return grouped.select("date", kind.alias("kind"), *[c for c in grouped.columns if c not in ("date", "missing")])


def store_days(state: DataFrame, dest: str) -> None:
    """Keep the state of its days, in a folder per date; a day that is stored already is replaced."""
    (state.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(located(dest)))


def update_days(status: DataFrame, dest: str, step_min: int = 15) -> None:
    """Make and store the state of the days that ``status`` has and the destination lacks; of other days only the date is read."""
    spark: SparkSession = status.sparkSession
    try:
        held = spark.read.parquet(located(dest)).select(F.col("date").alias("held")).distinct()
    except AnalysisException:  # nothing is stored yet
        return store_days(day_state(status, step_min), dest)
    day = F.col("date") if "date" in status.columns else F.to_date("fetched_at")
    days = status.select(day.alias("day")).distinct().join(held, F.col("day").eqNullSafe(F.col("held")), "left_anti")
    new = [row["day"] for row in days.collect()]  # bounded by the calendar
    wanted = day.isin([d for d in new if d is not None]) | (day.isNull() if None in new else F.lit(False))
    return store_days(day_state(status.where(wanted), step_min), dest)


def runs_of(state: DataFrame) -> DataFrame:
    """(fetched_at, n): each run once."""
    return state.where(F.col("kind") == RUN).select("fetched_at", "n")


def stations_of(state: DataFrame) -> DataFrame:
    """(station_id, places, fetched_at, n, counts...): each station once per day and number of places, as last seen then."""
    return state.where(F.col("kind") == STATION).select(
        "station_id", "places", F.col("last_seen").alias("fetched_at"), "n", "nulls_bikes", "types_incoherents", "negatifs",
        "hors_service", "non_installees")


def buckets_of(state: DataFrame) -> DataFrame:
    """(station_id, ts, n_bikes): the latest observation of each bucket, as ``latest_per_bucket`` has it."""
    return state.where(F.col("kind") == BUCKET).select("station_id", "ts", "n_bikes")


def ages_of(state: DataFrame) -> DataFrame:
    """(second, n): rows per second of age."""
    return (state.where((F.col("kind") == AGE) & F.col("second").isNotNull()).groupBy("second").agg(F.sum("n").alias("n")))


def day_sketches(status: DataFrame, accuracy: float = 0.01) -> DataFrame:
    """(date, n, debut, fin, runs, stations, aged, over_6h, over_24h, oldest, ages): one row per day, with sketches that merge."""
    age = report_age()
    over = [F.count_if(age > F.expr(f"INTERVAL '{h}' HOUR")).alias(f"over_{h}h") for h in (6, 24)]
    return status.groupBy(F.to_date("fetched_at").alias("date")).agg(
        F.count("*").alias("n"), F.min("fetched_at").alias("debut"), F.max("fetched_at").alias("fin"),
        instants_sketch("fetched_at", accuracy).alias("runs"), keys_sketch("station_id", accuracy).alias("stations"),
        F.count(age).alias("aged"), *over, F.max(age).alias("oldest"), interval_sketch(age, accuracy).alias("ages"))


def volume_of_days(days: DataFrame, step_min: int = 15) -> DataFrame:
    """:func:`snapgrid.operators.coverage.volume` of the days together."""
    return rated(days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_lignes"), distinct_of("runs").alias("n_runs"), F.min("debut").alias("debut"),
        F.max("fin").alias("fin"), distinct_of("stations").alias("n_stations")), step_min)


def keys_of_days(days: DataFrame) -> DataFrame:
    """:func:`snapgrid.operators.coverage.keys_per_day` from a row per day."""
    return days.groupBy(F.col("date").alias("jour")).agg(distinct_of("stations").alias("n_stations")).orderBy(F.asc_nulls_last("jour"))


def freshness_of_days(days: DataFrame) -> DataFrame:
    """:func:`snapgrid.operators.freshness.freshness` of the days together; only its quantiles are estimates."""
    merged = days.agg(F.kll_merge_agg_bigint("ages").alias("ages"), F.max("oldest").alias("oldest"),
                      *[F.sum(c).alias(c) for c in ("aged", "over_6h", "over_24h")])
    return merged.select(*rounded(seconds_of(F.col("ages"), [0.5, 0.9, 0.99]), interval_micros(F.col("oldest")) / 1e6),
                         *[percent(F.col(f"over_{h}h"), F.col("aged"), 2).alias(f"pct_sup_{h}h") for h in (6, 24)])
