"""What a source holds: columns, bounds, a preview, and fitness for the audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.schema import OPTIONAL, REQUIRED, is_nested

_TIMED = (T.TimestampType, T.TimestampNTZType)


def describe(df: DataFrame) -> DataFrame:
    """One row per column: position, column, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def bounds(df: DataFrame) -> DataFrame:
    """One row: rows, and where the columns exist the period, distinct runs and stations.

    The distinct counts share one scan with the number of rows: a grouping by run and one by station, both combined map-side.
    """
    keys = [name for name in ("fetched_at", "station_id") if name in df.columns]
    if not keys:
        return df.agg(F.count("*").alias("n_lignes"))
    grouped = df.select(*keys).groupingSets([[F.col(name)] for name in keys], *map(F.col, keys)).agg(
        F.grouping_id().alias("missing"), F.count("*").alias("n"))
    by = {name: F.col("missing") == sum(1 << (len(keys) - 1 - at) for at, other in enumerate(keys) if other != name) for name in keys}
    out = [F.coalesce(F.sum(F.when(by[keys[0]], F.col("n"))), F.lit(0)).alias("n_lignes")]
    if "fetched_at" in keys:
        out += [F.min("fetched_at").alias("debut"), F.max("fetched_at").alias("fin"),
                F.count(F.when(by["fetched_at"], F.col("fetched_at"))).alias("n_runs")]
    if "station_id" in keys:
        out.append(F.count(F.when(by["station_id"], F.col("station_id"))).alias("n_stations"))
    return grouped.agg(*out)


# A text inside a nested value stands in quotes if it could be taken for something else without them.
_UNCLEAR = r"""^$|^\s|\s$|^(?i:null)$|[\[\]{}(),'":=\\]"""


def as_text(c: Column, dtype: T.DataType, inside: bool = False) -> Column:
    """A value of any type as text: ``{'field': value}``, ``[a, b]``, ``{key=value}``; NULL inside another value is ``NULL``."""
    def listed(items: Column) -> Column:
        return F.array_join(items, ", ")

    if isinstance(dtype, T.StructType):
        fields = [F.concat(F.lit(f"'{f.name}': "), as_text(c[f.name], f.dataType, True)) for f in dtype.fields]
        text = F.concat(F.lit("{"), listed(F.array(*fields)), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        text = F.concat(F.lit("["), listed(F.transform(c, lambda x: as_text(x, dtype.elementType, True))), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda x: F.concat(
            as_text(x["key"], dtype.keyType, True), F.lit("="), as_text(x["value"], dtype.valueType, True)))
        text = F.concat(F.lit("{"), listed(pairs), F.lit("}"))
    else:
        text = c.cast("string")
        if inside and isinstance(dtype, (T.StringType, *_TIMED)):
            escaped = F.regexp_replace(text, r"(['\\])", r"\\$1")
            text = F.when(text.rlike(_UNCLEAR), F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(text)
    text = F.when(c.isNotNull(), text)
    return F.coalesce(text, F.lit("NULL")) if inside else text


def preview(df: DataFrame, n: int = 3, width: int = 34, order: Sequence[str] = ()) -> DataFrame:
    """``n`` rows as text, each value cut to ``width`` characters; the first ones by ``order``, or any."""
    chosen = (df.orderBy(*order) if order else df).limit(n)
    return chosen.select([F.left(as_text(F.col(f"`{f.name}`"), f.dataType), F.lit(width)).alias(f.name) for f in df.schema.fields])


def conformance(df: DataFrame, required: Sequence[str] = REQUIRED, optional: Sequence[str] = OPTIONAL,
                time_axis: str = "fetched_at") -> DataFrame:
    """One row per finding ``(check, column, ok)``; columns are matched by name only.

    Checks: each required and optional column, each nested column that still
    has to be flattened, the time axis, and the overall verdict, which fails
    only on a missing required column.
    """
    have = set(df.columns)
    rows = [("required", c, c in have) for c in required]
    rows += [("optional", c, c in have) for c in optional]
    rows += [("nested", f.name, False) for f in df.schema.fields if is_nested(f.dataType)]
    rows.append(("time_axis", time_axis, time_axis in have))
    rows.append(("usable", None, conforms(df, required)))
    return df.sparkSession.createDataFrame(rows, "check string, column string, ok boolean")


def conforms(df: DataFrame, required: Sequence[str] = REQUIRED) -> bool:
    return set(required) <= set(df.columns)
