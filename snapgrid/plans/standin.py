"""The driver's tables seen as snapshot tables, so that queries have inputs.

``events`` plays the status history (user = station) and ``orders`` the
reference snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.functions.time import DAY, bucket, floor_to, from_micros, micros

# Fixed value: stations per envelope at most, so that no list grows with the data.
LIST_SIZE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.col("k").cast("bigint") * F.col("k") * F.col("k") * -100_000
    bikes = F.when((F.col("event_type") == "error") & (F.col("k") % 10 == 0), F.lit(None)).otherwise(
        F.floor(F.col("value") / 20).cast("int"))
    nba = F.col("nba")
    return (
        table(spark, sf_dir, "events").withColumn("k", _k()).withColumn("nba", bikes)
        .select(
            "event_id", F.col("user_id").alias("station_id"), F.col("ts").alias("fetched_at"),
            F.timestamp_add("MICROSECOND", lag, F.col("ts")).alias("last_reported"),
            nba.alias("num_bikes_available"),
            (nba - nba % 3 + F.when(F.col("k") % 25 == 0, 1).otherwise(0)).alias("mechanical"),
            (nba % 3).alias("ebike"), (F.lit(20) - nba).alias("num_docks_available"),
            (F.col("k") % 50 != 0).alias("is_renting"), (F.col("k") % 97 != 0).alias("is_installed"),
        )
    )


def run_status(spark: SparkSession, sf_dir: str, step_min: int = 15) -> DataFrame:
    """Status rows whose collection instant is snapped to the step, so that events share runs."""
    return status(spark, sf_dir).withColumn("fetched_at", bucket("fetched_at", step_min))


def gappy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows of which some lack their time or station; every tenth station has no time at all."""
    untimed = (F.col("event_id") % 11 == 0) | (F.col("station_id") % 10 == 7)
    return status(spark, sf_dir).withColumns({
        "fetched_at": F.when(~untimed, F.col("fetched_at")),
        "station_id": F.when(F.col("event_id") % 13 != 0, F.col("station_id"))})


def damaged_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows with copies, and with counts beyond any station."""
    whole = status(spark, sf_dir)
    bikes = F.when(F.col("event_id") % 70 == 3, F.lit(200)).otherwise(F.col("num_bikes_available"))
    return whole.unionByName(whole.where("event_id % 50 = 0")).withColumn("num_bikes_available", bikes)


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("station_id"), F.col("o_orderdate").alias("fetched_at"),
        F.col("o_orderkey").alias("snap_id"),
        (F.floor("o_totalprice").cast("bigint") % 40).alias("capacity"),
    )


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station entry per event, with its nested type list and the day of its run."""
    count = F.floor(F.col("value") / 20).cast("int")
    kind = "struct<mechanical:int,ebike:int>"

    def entry(mechanical: Column | None, ebike: Column | None) -> Column:
        none = F.lit(None).cast("int")
        return F.struct((none if mechanical is None else mechanical).alias("mechanical"),
                        (none if ebike is None else ebike).alias("ebike")).cast(kind)

    nba, k = F.col("nba"), F.col("k")
    types = (
        F.when(k % 10 == 0, F.array().cast(f"array<{kind}>"))
        .when(k % 7 == 0, F.array(entry(nba, None), entry(nba + 1, None)))
        .otherwise(F.array(entry(nba - nba % 3, None), entry(None, nba % 3)))
    )
    return (
        table(spark, sf_dir, "events").withColumn("k", _k()).withColumn("nba", count)
        .select(
            from_micros(floor_to(micros("ts"), DAY)).alias("run"), "event_id",
            F.struct(
                F.col("event_id").alias("station_id"), F.col("user_id").cast("string").alias("stationCode"),
                nba.alias("num_bikes_available"), (20 - nba).alias("num_docks_available"),
                types.alias("num_bikes_available_types"),
                (k % 97 != 0).cast("int").alias("is_installed"), (k % 50 != 0).cast("int").alias("is_renting"),
                F.lit(1).alias("is_returning"),
                F.floor(micros("ts") / 1_000_000).cast("bigint").alias("last_reported"),
            ).alias("station"),
        )
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed envelopes: date and stamp of the run, and ``data.stations`` with at most LIST_SIZE entries each."""
    stamp = F.date_format("run", "yyyyMMdd'T'HHmmss'Z'").alias("stamp")
    return (
        feed_rows(spark, sf_dir)
        .groupBy(stamp, F.floor(F.col("event_id") / LIST_SIZE).alias("part"))
        .agg(F.collect_list("station").alias("stations"), F.max("station.last_reported").alias("newest"))
        .select(F.to_date("stamp", "yyyyMMdd'T'HHmmss'Z'").alias("date"), "stamp", F.col("newest").alias("last_updated"),
                F.when(F.col("part") % 2 == 0, F.col("newest")).otherwise(F.lit(0)).alias("lastUpdatedOther"),
                F.struct("stations").alias("data"))
    )
