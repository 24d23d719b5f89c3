"""Time arithmetic on UTC wall-clock TIMESTAMP_NTZ columns.

Everything works on NTZ values or on microseconds since 1970, so no result
depends on the session time zone.  Turning a timestamp into microseconds costs
more than comparing or bucketing it, so operators do that after reducing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Fixed value: buckets count from this Monday, in microseconds since 1970.
BUCKET_ORIGIN = 946_857_600 * SECOND  # 2000-01-03 00:00:00

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval_micros(interval: Column) -> Column:
    """Length of a day-time interval in whole microseconds (bigint)."""
    seconds = interval.cast("interval second").cast("decimal(18,6)")
    return (seconds * SECOND).cast("bigint")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of an NTZ timestamp."""
    return interval_micros(_col(ts) - F.expr(_EPOCH))


def from_micros(us: Column | str) -> Column:
    """NTZ timestamp of a microsecond count; inverse of :func:`micros`."""
    return F.expr(_EPOCH) + F.expr("INTERVAL '0.000001' SECOND") * _col(us)


def seconds(us: Column | str) -> Column:
    """Microseconds as seconds (double)."""
    return _col(us) / F.lit(float(SECOND))


def floor_to(us: Column | str, width: int, origin: int = 0) -> Column:
    """Largest ``origin + k * width`` not above ``us``; exact for negatives too."""
    us = _col(us)
    return us - F.pmod(us - F.lit(origin), F.lit(width))


def bucket(ts: Column | str, step_min: int) -> Column:
    """Start of the ``step_min`` bucket holding the NTZ timestamp ``ts``; NULL for NULL.

    The built-in time window is the cheapest form, and like all of Spark a
    query may use only one of them per projection.
    """
    shift = BUCKET_ORIGIN // MINUTE % step_min
    # the window would drop rows without a time
    start = F.window(F.coalesce(_col(ts), F.expr(_EPOCH)), f"{step_min} minutes", startTime=f"{shift} minutes").start
    return F.when(_col(ts).isNotNull(), start)


def minute_number(ts: Column | str) -> Column:
    """Minutes since 1970 of an NTZ timestamp, from cheap calendar fields."""
    ts = _col(ts)
    return F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def local_hour(us: Column | str, tz: str = "Europe/Paris") -> Column:
    """Hour of day in ``tz`` at a UTC instant given in microseconds since 1970.

    ``tz`` is an IANA zone (daylight saving applied) or ``"fixed+N"`` for a
    constant offset of N hours.
    """
    if tz.startswith("fixed"):
        local = _col(us) + int(tz[len("fixed"):]) * HOUR
    else:
        local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(_col(us)), tz))
    return F.floor(F.pmod(local, F.lit(DAY)) / HOUR)
