"""Nested feed envelopes to one row per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.functions.feed import stamp_of, stamped, type_count
from snapgrid.schema import STATUS, cast_to, to_ntz

KINDS = ("mechanical", "ebike")

# The column that holds an envelope's stamp until its stations are rows.
STAMP = "_stamp"


def stations_path(schema: T.StructType) -> str | None:
    """Where the station list sits: ``data.stations``, ``stations`` or None when already flat."""
    names = schema.fieldNames()
    if "station_id" in names:
        return None
    if "data" in names and isinstance(schema["data"].dataType, T.StructType) \
            and "stations" in schema["data"].dataType.fieldNames():
        return "data.stations"
    if "stations" in names:
        return "stations"
    return None


def flatten_envelope(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per listed station, its fields as columns, after the ``keep`` columns.

    A table that is already flat comes back unchanged; an empty list gives no row.
    """
    path = stations_path(df.schema)
    return df if path is None else df.select(*keep, F.inline(F.col(path)))


def split_types(df: DataFrame, merge: str = "first", default: int | None = 0,
                column: str = "num_bikes_available_types", kinds: Sequence[str] = KINDS) -> DataFrame:
    """Replace the nested bike-type list by one count column per kind.

    ``merge="first"`` with default 0 is the conversion's rule, ``"last"`` with
    default None the landing's.
    """
    if column not in df.columns:
        return df
    counts = {kind: type_count(column, kind, merge, default) for kind in kinds}
    return df.withColumns(counts).drop(column)


def flat_status(df: DataFrame, on_bad_stamp: str = "fail") -> DataFrame:
    """Envelope or flat JSON rows as canonical status rows.

    ``filename`` gives ``fetched_at`` when the rows have none.  A name without
    a stamp fails the job, or with ``on_bad_stamp="null"`` leaves the time NULL
    so that :func:`snapgrid.sources.convert.convert` can set the rows aside.
    """
    keep = ["filename"] if "filename" in df.columns else []
    if keep and stations_path(df.schema):
        # read once per envelope; an envelope that lists nothing needs no stamp
        df, keep = df.withColumn(STAMP, stamp_of("filename", strict=False)), [*keep, STAMP]
    rows = split_types(flatten_envelope(df, keep), "first", 0)
    have = {f.name: f.dataType for f in rows.schema.fields}

    strict = on_bad_stamp == "fail"
    if "fetched_at" in have:
        fetched = to_ntz(F.col("fetched_at"), have["fetched_at"])
    elif STAMP in have:
        fetched = stamped(STAMP, "filename") if strict else F.col(STAMP)
    else:
        fetched = stamp_of("filename", strict=strict)
    columns = []
    for field in STATUS.fields:
        if field.name == "fetched_at":
            c = fetched
        elif field.name == "date":
            c = fetched.cast("date")
        elif field.name in have:
            c = cast_to(F.col(field.name), have[field.name], field.dataType)
        elif field.name in KINDS:
            c = F.lit(0)
        else:
            c = F.lit(None).cast(field.dataType)
        columns.append(c.alias(field.name))
    return rows.select(columns)


def landed_rows(df: DataFrame, ingested_at=None) -> DataFrame:
    """Feed rows as the collector keeps them.

    All station fields stay, the type list becomes counts (last entry wins,
    a missing type is NULL), and two columns are added: the collection instant
    and the feed's own update time, where 0 counts as not given.
    """
    path = stations_path(df.schema)
    if path is None:
        raise ValueError("landing needs a feed envelope with a station list")
    names = df.schema.fieldNames()
    updates = [F.nullif(F.col(c), F.lit(0)) for c in ("lastUpdatedOther",) if c in names]
    updates += [F.col(c) for c in ("last_updated",) if c in names]
    feed = F.coalesce(*updates) if updates else F.lit(None).cast("bigint")
    if ingested_at is None:
        df, ingested_at = df.withColumn(STAMP, stamp_of("filename", strict=False)), stamped(STAMP, "filename")
    rows = df.select(F.inline(F.col(path)), ingested_at.alias("ingested_at"), feed.alias("feed_last_updated"))
    return split_types(rows, "last", None)
