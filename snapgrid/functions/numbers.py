"""Rounding and ratios on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column, digits: int = 0) -> Column:
    """Round the binary double half away from zero at ``digits`` decimals.

    Scaling first keeps 1.005 at 1.00: its nearest double lies below the tie,
    while rounding by decimal text would give 1.01.
    """
    scale = float(10 ** digits)
    return F.round(x.cast("double") * scale) / scale


def ratio(part: Column, total: Column) -> Column:
    """``part / total`` as a double, NULL when ``total`` is 0."""
    return F.try_divide(part.cast("double"), total.cast("double"))


def percent(part: Column, total: Column, digits: int) -> Column:
    return round_to(F.try_divide(part.cast("double") * 100.0, total.cast("double")), digits)
