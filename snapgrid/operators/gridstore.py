"""The grid as a stored table that grows day by day, and the target read from it without a shuffle.

Cells lie in folders by date and, within them, in buckets by station.  A reader finds all cells of a station in one task, so windows over
a station's cells, the target's among them, need no exchange.  An append makes the cells from the stored end to its own last
observation: of the new rows, of the stations that the store knows (a list beside the grid), and for stations that are new also
the empty cells of the time before.  The stored cells themselves are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapgrid.functions.time import HOUR, MINUTE, from_micros, local_hour, micros
from snapgrid.operators.baseline import horizon_cells
from snapgrid.operators.latest import latest_per_bucket
from snapgrid.operators.timegrid import aligned, fill_cells

BUCKETS = 64

# Stations in a bucket when a table is made: one task sorts all cells of a bucket, about 3 million a month at steps of 15 minutes.
STATIONS = 1000


class BehindTheGrid(ValueError):
    """Rows lie before the stored end; they need the days from theirs on to be made again."""


@dataclass(frozen=True)
class GridStore:
    """A stored grid: the tables ``name`` (cells), ``name_stations`` and ``name_span`` (one row).

    ``buckets`` is the least number of buckets.  The first append makes more of them for more than ``STATIONS`` stations each.
    """

    spark: SparkSession
    name: str
    step_min: int = 15
    buckets: int = BUCKETS

    def span(self) -> tuple[int, int] | None:
        """First and last step, in microseconds; None where nothing is stored."""
        if not self.spark.catalog.tableExists(f"{self.name}_span"):
            return None
        row = self.spark.table(f"{self.name}_span").agg(F.min("first").alias("first"), F.max("last").alias("last")).first()
        return row["first"], row["last"]

    def n_buckets(self, stations: int) -> int:
        """The buckets that the table has, or is to be made with for so many stations."""
        if self.spark.catalog.tableExists(self.name):
            told = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            return int(told["data_type"])
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        return max(self.buckets, min(-(-stations // STATIONS), most))

    def append(self, status: DataFrame, value: str = "num_bikes_available") -> None:
        """Add the cells up to the last of these observations, which are all those since the stored end.

        A day's rows come in one call, for its buckets to be whole.  One writer at a time is to append.
        """
        if not aligned(self.step_min):
            raise ValueError("a stored grid needs a step that divides the hour")
        width, held = self.step_min * MINUTE, self.span()
        seen = status.agg(F.min(micros("fetched_at")).alias("low"), F.max(micros("fetched_at")).alias("high"),
                          F.approx_count_distinct("station_id").alias("stations")).first()
        if seen["low"] is None:
            raise ValueError("no row has a time")
        start = held[1] + width if held else seen["low"] - seen["low"] % HOUR
        if seen["low"] < start:
            raise BehindTheGrid(f"the grid is stored up to {held[1]}, a row is of {seen['low']}")
        steps = (seen["high"] - start) // width + 1

        own = status.select("station_id").distinct()
        known = self.spark.table(f"{self.name}_stations") if held else own.limit(0)
        cell = ((micros("ts") - F.lit(start)) / width).cast("bigint")
        observed = latest_per_bucket(status, self.step_min, value).select(
            "station_id", cell.alias("cell"), F.when(F.col("station_id").isNotNull(), F.col("n_bikes")).alias("n_bikes"))
        silent = known.select("station_id", F.lit(None).cast("bigint").alias("cell"), F.lit(None).cast("int").alias("n_bikes"))
        both = observed.unionByName(silent).select("station_id", F.lit(start).alias("t0"), F.lit(steps).alias("n_steps"), "cell", "n_bikes")
        cells = fill_cells(both, self.step_min, ["n_bikes"]).select("station_id", "ts", "n_bikes")
        fresh = own.join(known.select(F.col("station_id").alias("held")), F.col("station_id").eqNullSafe(F.col("held")), "left_anti")
        if held:
            before = F.explode(F.sequence(F.lit(held[0]), F.lit(held[1]), F.lit(width)))
            cells = cells.unionByName(fresh.select("station_id", before.alias("us")).select(
                "station_id", from_micros("us").alias("ts"), F.lit(None).cast("int").alias("n_bikes")))
        buckets = self.n_buckets(seen["stations"])
        (cells.withColumn("date", F.to_date("ts")).repartition(buckets, "station_id").write.mode("append").partitionBy("date")
         .bucketBy(buckets, "station_id").sortBy("station_id", "ts").saveAsTable(self.name))
        fresh.write.mode("append").saveAsTable(f"{self.name}_stations")
        span = [(held[0] if held else start, start + (steps - 1) * width)]
        self.spark.createDataFrame(span, "first bigint, last bigint").coalesce(1).write.mode("append").saveAsTable(f"{self.name}_span")

    def cells(self) -> DataFrame:
        """(station_id, ts, n_bikes, is_imputed) of every cell."""
        return self.spark.table(self.name).select("station_id", "ts", "n_bikes", F.col("n_bikes").isNull().alias("is_imputed"))

    def target(self, horizon_min: int = 60, tz: str = "Europe/Paris") -> DataFrame:
        """:func:`snapgrid.operators.baseline.target` of the stored cells.  Every step is there, so the later cell is some rows ahead."""
        ahead = horizon_cells(self.step_min, horizon_min)
        per_station = Window.partitionBy("station_id").orderBy("ts")
        return self.cells().select(
            "station_id", "ts", "n_bikes", "is_imputed", F.lead("n_bikes", ahead).over(per_station).alias("y"),
            F.lead("is_imputed", ahead).over(per_station).alias("y_imputed"), local_hour(micros("ts"), tz).alias("h_paris"))
