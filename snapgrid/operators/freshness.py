"""How old the sensors' own reports are when they are collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.functions.numbers import percent, round_to
from snapgrid.functions.quantiles import exact_quantiles, second_counts
from snapgrid.functions.sketches import interval_sketch, seconds_of
from snapgrid.functions.time import interval_micros


def report_age() -> Column:
    """Interval between a station's own report and its collection."""
    return F.col("fetched_at") - F.col("last_reported")


def freshness(status: DataFrame, limits_h: Sequence[int] = (6, 24), counts: DataFrame | None = None,
              accuracy: float | None = None) -> DataFrame:
    """One row: three age quantiles (s, min, h), greatest age, share above each limit.

    Rows without ``last_reported`` are left out; negative ages stay.  ``counts`` gives the rows per second of age where they
    are known, as (second, n); ``status`` is then read for the seconds around the quantiles only.  ``accuracy`` takes the
    quantiles from a sketch of that rank error, in one scan; all else stays exact.
    """
    age = report_age()
    if accuracy is not None:
        over = [percent(F.count_if(age > F.expr(f"INTERVAL '{h}' HOUR")), F.count(age), 2).alias(f"pct_sup_{h}h") for h in limits_h]
        found = status.agg(interval_sketch(age, accuracy).alias("ages"), F.max(age).alias("oldest"), *over)
        return found.select(*rounded(seconds_of(F.col("ages"), [0.5, 0.9, 0.99]), interval_micros(F.col("oldest")) / 1e6),
                            *[f"pct_sup_{h}h" for h in limits_h])
    known = second_counts(status, age) if counts is None else counts
    above = [percent(F.sum(F.when(F.col("second") > h * 3600, F.col("n")).otherwise(0)), F.sum("n"), 2)
             .alias(f"pct_sup_{h}h") for h in limits_h]
    ages = exact_quantiles(status, age, [0.5, 0.9, 0.99, 1.0], counts)  # the greatest age is the last quantile
    return ages.crossJoin(F.broadcast(known.agg(*above))).select(
        *rounded(F.col("q"), F.get("q", F.lit(3))), *[f"pct_sup_{h}h" for h in limits_h])


def rounded(quantiles: Column, oldest: Column) -> list[Column]:
    """The reported columns from the three quantiles and the greatest age, in seconds."""
    at = [F.get(quantiles, F.lit(i)) for i in range(3)]
    return [round_to(at[0]).alias("p50_s"), round_to(at[1] / 60.0).alias("p90_min"), round_to(at[2] / 3600.0, 1).alias("p99_h"),
            round_to(oldest / 3600.0, 1).alias("max_h")]
