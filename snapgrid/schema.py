"""Canonical schemas and the step that brings any snapshot table to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.functions.time import SECOND, from_micros

STATUS = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("stationCode", T.StringType()),
    T.StructField("num_bikes_available", T.IntegerType()),
    T.StructField("num_docks_available", T.IntegerType()),
    T.StructField("mechanical", T.IntegerType()),
    T.StructField("ebike", T.IntegerType()),
    T.StructField("is_installed", T.BooleanType()),
    T.StructField("is_renting", T.BooleanType()),
    T.StructField("is_returning", T.BooleanType()),
    T.StructField("last_reported", T.TimestampNTZType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("date", T.DateType()),
])

INFO = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("capacity", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])

BIKE_TYPES = T.ArrayType(T.StructType([
    T.StructField("mechanical", T.IntegerType()),
    T.StructField("ebike", T.IntegerType()),
]))

STATION = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("stationCode", T.StringType()),
    T.StructField("num_bikes_available", T.IntegerType()),
    T.StructField("num_docks_available", T.IntegerType()),
    T.StructField("num_bikes_available_types", BIKE_TYPES),
    T.StructField("is_installed", T.IntegerType()),
    T.StructField("is_renting", T.IntegerType()),
    T.StructField("is_returning", T.IntegerType()),
    T.StructField("last_reported", T.LongType()),
])

ENVELOPE = T.StructType([
    T.StructField("last_updated", T.LongType()),
    T.StructField("lastUpdatedOther", T.LongType()),
    T.StructField("data", T.StructType([T.StructField("stations", T.ArrayType(STATION))])),
])

# What an audit needs, and what it can use when present.
REQUIRED = ["station_id", "fetched_at", "last_reported", "num_bikes_available",
            "num_docks_available", "is_renting", "is_installed"]
OPTIONAL = ["mechanical", "ebike", "stationCode"]

# Columns a landed snapshot names differently.
LANDED_RENAMES = {"ingested_at": "fetched_at"}


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.MapType, T.ArrayType))


# A time of day followed by a zone: Z, or an offset from UTC.
ZONED = r":\d{1,2}(\.\d+)?\s*([Zz]|[+-]\d{1,2}(:\d{2})?)\s*$"


def to_ntz(c: Column, dtype: T.DataType) -> Column:
    """UTC wall clock of an instant, epoch seconds, date, text or NTZ column; text may name its offset from UTC."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.TimestampType):
        return from_micros(F.unix_micros(c))
    if isinstance(dtype, T.IntegralType):
        return from_micros(c.cast("bigint") * SECOND)
    if isinstance(dtype, T.FractionalType):
        return from_micros(F.round(c.cast("double") * float(SECOND)).cast("bigint"))
    if isinstance(dtype, T.StringType):
        instant = from_micros(F.unix_micros(F.when(c.rlike(ZONED), c).cast("timestamp")))
        return F.when(c.rlike(ZONED), instant).otherwise(F.when(~c.rlike(ZONED), c).cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def cast_to(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if isinstance(want, T.TimestampNTZType):
        return to_ntz(c, have)
    return c.cast(want)


def canonicalise(df: DataFrame, schema: T.StructType = STATUS, renames: dict[str, str] | None = None,
                 extras: bool = False) -> DataFrame:
    """Rename, cast and order columns to ``schema``; a missing one becomes NULL.

    A missing ``date`` is taken from ``fetched_at``.  ``extras`` keeps further
    columns behind the canonical ones.
    """
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for field in schema.fields:
        if field.name in have:
            c = cast_to(F.col(f"`{field.name}`"), have[field.name], field.dataType)
        elif field.name == "date" and "fetched_at" in have:
            c = to_ntz(F.col("fetched_at"), have["fetched_at"]).cast("date")
        else:
            c = F.lit(None).cast(field.dataType)
        columns.append(c.alias(field.name))
    if extras:
        known = set(schema.fieldNames())
        columns += [F.col(f"`{name}`") for name in df.columns if name not in known]
    return df.select(columns)
