"""Columns of the raw feed: file-name stamps and the nested bike-type list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a collection instant is written in a snapshot's path.
STAMP_PATTERN = r"(\d{8}T\d{6})Z"
STAMP_FORMAT = "yyyyMMdd'T'HHmmss"


def stamp_of(path: Column | str, strict: bool = True) -> Column:
    """Collection instant written in a file path.

    A path without a stamp fails the job when ``strict``, else gives NULL.
    """
    path = F.col(path) if isinstance(path, str) else path
    text = F.nullif(F.regexp_extract(path, STAMP_PATTERN, 1), F.lit(""))
    parsed = F.try_to_timestamp(text, F.lit(STAMP_FORMAT)).cast("timestamp_ntz")
    return stamped(parsed, path) if strict else parsed


def stamped(stamp: Column | str, path: Column | str) -> Column:
    """The stamp found in a path; one that is NULL fails the job."""
    stamp, path = (F.col(c) if isinstance(c, str) else c for c in (stamp, path))
    message = F.concat(F.lit("no collection stamp in file name: "), path)
    return F.when(stamp.isNull(), F.raise_error(message).cast("timestamp_ntz")).otherwise(stamp)


def type_count(types: Column | str, kind: str, merge: str = "first", default: int | None = 0) -> Column:
    """Count of one bike type in ``array<struct<mechanical, ebike>>``.

    ``merge`` says which entry holds when a type is listed twice; a missing
    type gives ``default``.
    """
    types = F.col(types) if isinstance(types, str) else types
    named = F.filter(types, lambda entry: entry[kind].isNotNull())
    if merge == "first":
        entry = F.get(named, F.lit(0))
    elif merge == "last":
        entry = F.try_element_at(named, F.lit(-1))
    else:
        raise ValueError(f"merge must be 'first' or 'last', not {merge!r}")
    count = entry[kind]
    return count if default is None else F.coalesce(count, F.lit(default))
