"""Mergeable sketches: distinct counts (HyperLogLog) and quantiles (KLL) of a stated accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapgrid.functions.time import interval_micros, micros


def distinct_size(accuracy: float) -> int:
    """Buckets, as a power of two, for a relative standard error of at most ``accuracy``."""
    _checked(accuracy)
    return next((n for n in range(4, 21) if 1.04 / 2 ** (n / 2) <= accuracy), 21)


def quantile_size(accuracy: float) -> int:
    """The sketch's k for a rank error of about ``accuracy`` (99 % of the time)."""
    return max(8, min(65_535, round((2.296 / _checked(accuracy)) ** (1 / 0.9021))))


def _checked(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy lies between 0 and 1")
    return accuracy


def instants_sketch(ts: str, accuracy: float) -> Column:
    """Distinct instants, as an aggregate."""
    return F.hll_sketch_agg(micros(ts), distinct_size(accuracy))


def keys_sketch(key: str, accuracy: float) -> Column:
    """Distinct keys of any simple type, as an aggregate."""
    return F.hll_sketch_agg(F.col(key).cast("string"), distinct_size(accuracy))


def interval_sketch(interval: Column, accuracy: float) -> Column:
    """Quantiles of an interval, as an aggregate."""
    return F.kll_sketch_agg_bigint(interval_micros(interval), quantile_size(accuracy))


def distinct_of(sketch: Column | str) -> Column:
    """Estimated number of distinct values of many sketches together, as an aggregate; 0 of none."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0))


def seconds_of(sketch: Column, qs: Sequence[float]) -> Column:
    """Estimated quantiles of one sketch, in seconds; NULLs where it holds nothing."""
    held = F.kll_sketch_get_n_bigint(sketch) > 0
    return F.array(*[F.when(held, F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(q))).cast("double") / 1e6) for q in qs])
