"""Exact interpolated quantiles of an interval column, without one big buffer.

The built-in ``percentile`` merges a value -> count map of all distinct values
into one task.  Here the wanted ranks are narrowed down instead: rows are
counted per second, a table that is combined map-side, small, and shared by
all consumers; the seconds that hold a rank are found in it; and a second
narrow scan looks at the rows of those seconds only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.functions.time import interval_micros

# Seconds per coarse slice.
DAY_SECONDS = 86_400


def upper_second(interval: Column) -> Column:
    """Whole seconds, rounded up from 0 on; never decreasing in the interval.

    An interval exceeds ``n >= 0`` seconds exactly if its upper second does.
    """
    return (interval + F.expr("INTERVAL '0.999999' SECOND")).cast("interval second").cast("bigint")


def second_counts(df: DataFrame, interval: Column) -> DataFrame:
    """``(second, n)``: rows per upper second, NULL left out."""
    return df.select(upper_second(interval).alias("second")).where("second IS NOT NULL") \
        .groupBy("second").agg(F.count("*").alias("n"))


def _narrow(counts: DataFrame, part: str) -> DataFrame:
    """Keep, for each wanted rank, the part that holds it, and make the rank relative to it."""
    running = Window.partitionBy("q", "side").orderBy(part)
    return (
        counts.withColumn("upto", F.sum("n").over(running))
        .where("rank >= upto - n AND rank < upto")
        .select("q", "side", "share", part, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
    )


def exact_quantiles(df: DataFrame, interval: Column, qs: Sequence[float], counts: DataFrame | None = None) -> DataFrame:
    """One row with column ``q`` = array of quantiles in seconds (double), in the order of ``qs``.

    The only unpartitioned window runs over one row per day of interval
    length, a number set by the span of the values and not by how many there
    are; the other windows hold at most 86,400 seconds and 2,000,000 distinct
    microseconds per wanted rank.  The broadcast lists have two rows per
    quantile: the ranks around it.  ``counts`` are the :func:`second_counts` where they are known.
    """
    # A key that cannot be NULL keeps join conditions from being pushed below the shared shuffle.
    seconds = (second_counts(df, interval) if counts is None else counts).withColumn("day", F.coalesce(
        F.col("second") - F.pmod("second", F.lit(DAY_SECONDS)), F.lit(0)))

    so_far = Window.orderBy("day")
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    position = F.col("quantile") * (F.col("total") - 1)
    ranks = F.posexplode(F.array(F.floor(position), F.ceil(position))).alias("side", "rank")
    in_day = (
        seconds.groupBy("day").agg(F.sum("n").alias("n"))
        .select("day", "n", F.sum("n").over(so_far).alias("upto"), F.sum("n").over(whole).alias("total"))
        .select("*", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("q", "quantile"))
        .select("*", (position - F.floor(position)).alias("share"), ranks)
        .where("rank >= upto - n AND rank < upto")
        .select("q", "side", "share", "day", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
    )
    in_second = _narrow(seconds.join(F.broadcast(in_day), "day"), "second")
    found = _narrow(
        df.select(upper_second(interval).alias("second"), interval.alias("v"))
        .join(F.broadcast(in_second), "second")
        .groupBy("q", "side", "share", "rank", "v").agg(F.count("*").alias("n")), "v")

    def value(q: int, side: int) -> Column:
        at = F.max(F.when((F.col("q") == q) & (F.col("side") == side), F.col("v")))
        return interval_micros(at) / 1e6

    def share(q: int) -> Column:
        return F.max(F.when(F.col("q") == q, F.col("share")))

    return found.agg(F.array(*[
        value(i, 0) + (value(i, 1) - value(i, 0)) * share(i) for i in range(len(qs))
    ]).alias("q"))
