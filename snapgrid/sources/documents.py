"""JSON files of any layout: one document, one per line, or several that span lines, read once.

A file's text is cut where one document ends and the next begins: after a closing brace or bracket that an opening one follows
with nothing but white space between, which no document has inside, except in a string.  Cuts inside a string are found by
the unescaped quotes before them, and undone.

Without a schema the documents are parsed once into variants, which are stored in the shared scratch folder; the schema is an
aggregate that the same pass computes, and rows are cast from what is stored.  A file is a row here, so files of very
many lines are better read with ``multiline=False``, in pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.session import scratch_dir

_BORDER = r"(?<=[}\]])(?=\s*[{\[])"
_BLANK = " \t\r\n﻿"
_OPTIONS = {"mode": "FAILFAST"}


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is worked out once, however often ``result`` names it."""
    return F.transform(F.array(value), result)[0]


def _in_string(text: Column) -> Column:
    """Whether a piece of JSON that begins outside a string ends in one: by its quotes without the escaped ones."""
    plain = F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\.", "")).otherwise(text)
    return _let(plain, lambda held: (F.octet_length(held) - F.octet_length(F.replace(held, F.lit('"'), F.lit("")))) % 2 == 1)


def _rejoined(pieces: Column) -> Column:
    """The pieces, those joined again between which a string was cut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(held: Column, piece: Column) -> Column:
        joined = F.concat(F.coalesce(held["open"], F.lit("")), piece)
        still = _in_string(joined)
        return F.struct(F.when(still, held["done"]).otherwise(F.array_append(held["done"], joined)).alias("done"),
                        F.when(still, joined).alias("open"))

    return F.aggregate(pieces, start, add, lambda held: F.when(held["open"].isNull(), held["done"]).otherwise(
        F.array_append(held["done"], held["open"])))


def documents(text: Column) -> Column:
    """The JSON documents of a text, in order, as an array of texts."""
    whole = _let(F.split(text, _BORDER), lambda pieces: F.when(F.exists(pieces, _in_string), _rejoined(pieces)).otherwise(pieces))
    return F.filter(F.transform(whole, lambda one: F.trim(one, F.lit(_BLANK))), lambda one: one != "")


def _listed(document: Column, kind: str) -> Column:
    """A document as the list of its rows: a list's entries, or itself."""
    return F.when(F.startswith(document, F.lit("[")), F.from_json(document, f"array<{kind}>", _OPTIONS)).otherwise(
        F.array(F.from_json(document, kind, _OPTIONS)))


def read_documents(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """(document, filename, partition columns...) of all files."""
    whole = spark.read.options(**options).text(paths, wholetext=True).withColumn("filename", F.col("_metadata.file_path"))
    rest = [name for name in whole.columns if name not in ("value", "filename")]
    return whole.select(F.explode(documents(F.col("value"))).alias("document"), "filename", *[f"`{name}`" for name in rest])


def parsed(found: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of (document, ...) by a schema, followed by the other columns; a document that is none fails by its file."""
    row = F.explode(_listed(F.col("document"), schema.simpleString())).alias("row")
    rest = [name for name in found.columns if name != "document" and name not in schema.names]
    return found.select(row, *[f"`{name}`" for name in rest]).select("row.*", *[f"`{name}`" for name in rest])


def plain_type(found: T.DataType) -> T.DataType:
    """A variant's type as columns have it: decimals are doubles, as JSON has no others, and what has no one type is text."""
    if isinstance(found, T.StructType):
        return T.StructType([T.StructField(f.name, plain_type(f.dataType)) for f in found.fields])
    if isinstance(found, T.ArrayType):
        return T.ArrayType(plain_type(found.elementType))
    if isinstance(found, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(found, (T.VariantType, T.NullType)) else found


def inferred(found: DataFrame) -> DataFrame:
    """The rows of (document, ...) by the schema that all documents have together.

    A field that some documents lack is NULL there; whole numbers beside fractions are doubles; a field of several other types
    is text, nested values as JSON.
    """
    spark, seen, path = found.sparkSession, Observation("documents"), scratch_dir(found.sparkSession, "documents")
    value = F.try_parse_json("document")
    bad = F.raise_error(F.concat(F.lit("not a JSON document in "), F.col("filename")))
    variant = F.when(value.isNull(), bad.cast("variant")).otherwise(value)
    entries = F.when(F.startswith("document", F.lit("[")), variant.cast("array<variant>")).otherwise(F.array(variant))
    rest = [f"`{name}`" for name in found.columns if name != "document"]
    rows = found.select(F.explode(entries).alias("row"), *rest)
    # above a repartition hint, where a plan that turns out empty is still observed
    rows.hint("rebalance").observe(seen, F.schema_of_variant_agg("row").alias("kind")).write.option("compression", "zstd").parquet(path)
    kind = (seen.get["kind"] or "VOID").replace("OBJECT<", "STRUCT<")
    schema = plain_type(T.StructType.fromDDL(f"row {kind}")["row"].dataType)
    stored = spark.read.schema(T.StructType([T.StructField("row", T.VariantType()), *(f for f in found.schema if f.name != "document")])).parquet(path)
    if not isinstance(schema, T.StructType):
        if seen.get["kind"] in (None, "VOID"):
            return stored.drop("row")
        raise SparkRuntimeException(f"JSON documents that are no objects: {seen.get['kind']}")
    rest = [f"`{f.name}`" for f in found.schema if f.name != "document" and f.name not in schema.names]
    return stored.select(F.col("row").cast(schema).alias("row"), *rest).select("row.*", *rest)
