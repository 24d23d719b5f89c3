"""Parquet files whose column types drifted, united by column name.

Counts written by one run as integers and by another as doubles cannot be read
with one schema.  The files are grouped by the schema in their footers, each
group is read with its own, and the groups are cast to the wider type.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.schema import cast_to, is_nested

_WHOLE = [T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_FLOATS = [T.FloatType(), T.DoubleType()]
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Decimal digits of the whole types.
_DIGITS = {T.BooleanType(): 1, T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}


def _wider_decimal(a: T.DataType, b: T.DataType) -> T.DataType:
    """The decimal that holds both, or a double where none has the digits."""
    a, b = (x if isinstance(x, T.DecimalType) else T.DecimalType(_DIGITS[x], 0) for x in (a, b))
    scale = max(a.scale, b.scale)
    digits = max(a.precision - a.scale, b.precision - b.scale) + scale
    return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest type that holds both; text when they have nothing in common.

    Truth values count as 0 and 1 beside numbers.  Structs are united by field name, lists and maps by their parts; a nested
    value beside another kind is text, as JSON.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    whole_or_decimal = [x in _WHOLE or isinstance(x, T.DecimalType) for x in (a, b)]
    if all(whole_or_decimal):
        return _wider_decimal(a, b)
    if all(known or x in _FLOATS for known, x in zip(whole_or_decimal, (a, b))):
        small = {T.BooleanType(), T.ByteType(), T.ShortType(), T.FloatType()}  # a float holds these
        return T.FloatType() if {a, b} <= small else T.DoubleType()
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        return T.TimestampNTZType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(wider(a.keyType, b.keyType), wider(a.valueType, b.valueType))
    return T.StringType()


def widened(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value as its wider type; struct fields by name, those it lacks NULL."""
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        held = {f.name: f.dataType for f in have.fields}
        fields = [(widened(c[f.name], held[f.name], f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name)
                  for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: widened(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        entries = F.transform(F.map_entries(c), lambda x: F.struct(
            widened(x["key"], have.keyType, want.keyType).alias("key"), widened(x["value"], have.valueType, want.valueType).alias("value")))
        return F.map_from_entries(entries)
    if is_nested(have) and isinstance(want, T.StringType):
        return F.to_json(c)
    return cast_to(c, have, want)


def common_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns in order of first appearance, each with its widest type."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    return T.StructType([T.StructField(name, dtype) for name, dtype in types.items()])


def _footer_schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spark schema of each file as JSON; only footers are read."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_schema

    for batch in batches:
        schemas = []
        for path in batch["path"]:
            uri = path.replace("s3a://", "s3://", 1).replace("file:///", "/", 1)
            filesystem, name = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))
            found = pq.read_schema(name, filesystem=filesystem).remove_metadata()
            schemas.append(from_arrow_schema(found, prefer_timestamp_ntz=True).json())
        yield pd.DataFrame({"path": batch["path"], "schema": schemas})


def file_schemas(spark: SparkSession, paths: Sequence[str], options: dict[str, str]) -> DataFrame:
    """``(path, schema)`` of every file, read in parallel."""
    files = (
        spark.read.format("binaryFile").options(**options)
        .option("pathGlobFilter", options.get("pathGlobFilter", "*.parquet"))
        .load(list(paths)).select("path")
    )
    width = spark.sparkContext.defaultParallelism
    return files.repartition(width, "path").mapInPandas(_footer_schemas, "path string, schema string")


def read_drifted(spark: SparkSession, paths: Sequence[str], options: dict[str, str],
                 provenance: bool = False) -> DataFrame:
    """Read the files group by group and unite them by name.

    Only file names and schemas reach the driver, which lists the files of any
    scan anyway.
    """
    groups: dict[str, list[str]] = {}
    for row in file_schemas(spark, paths, options).toLocalIterator():
        groups.setdefault(row["schema"], []).append(row["path"])
    schemas = {text: T.StructType.fromJson(json.loads(text)) for text in sorted(groups)}
    common = common_schema(list(schemas.values()))

    parts = []
    for text, schema in schemas.items():
        reader = spark.read.schema(schema)
        if len(paths) == 1 and options.get("recursiveFileLookup") != "true":
            reader = reader.option("basePath", paths[0])
        part = reader.parquet(*groups[text])
        if provenance:
            part = part.withColumn("filename", F.col("_metadata.file_path"))
        have = {f.name: f.dataType for f in part.schema.fields}
        want = {f.name: f.dataType for f in common.fields}
        parts.append(part.select([
            widened(F.col(f"`{name}`"), dtype, want.get(name, dtype)).alias(name) for name, dtype in have.items()
        ]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
