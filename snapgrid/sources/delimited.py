"""CSV whose column types are inferred from all of its values.

The text is read once: its fields go to the shared scratch folder as they are, and the same pass counts, for each column, how many values each
type can hold.  A column gets the narrowest type that holds all of them, or with ``tolerance`` all but that share; what does not
fit is then NULL and kept, as it was written, in a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.schema import to_ntz
from snapgrid.session import scratch_dir

UNFIT = "unfit"

_DAY = r"\d{4}-\d{2}-\d{2}"
_ZONE = r"(\s*([Zz]|[+-]\d{1,2}(:\d{2})?))?"


def _shaped(text: Column, pattern: str) -> Column:
    return F.when(F.trim(text).rlike(f"^({pattern})$"), F.trim(text))


def _whole(text: Column) -> Column:
    return _shaped(text, r"[+-]?\d{1,19}").try_cast("bigint")


def _fraction(text: Column) -> Column:
    return _shaped(text, r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Nn]a[Nn]|[+-]?[Ii]nf(inity)?").try_cast("double")


def _truth(text: Column) -> Column:
    return _shaped(text, "(?i:true|false)").try_cast("boolean")


def _day(text: Column) -> Column:
    return _shaped(text, _DAY).try_cast("date")


def _instant(text: Column) -> Column:
    shaped = _shaped(text, _DAY + r"([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?" + _ZONE + ")?")
    return F.when(shaped.try_cast("timestamp").isNotNull(), to_ntz(F.when(shaped.try_cast("timestamp").isNotNull(), shaped), T.StringType()))


# From the narrowest type on.
TYPES = {"bigint": _whole, "double": _fraction, "boolean": _truth, "date": _day, "timestamp_ntz": _instant}


def chosen(held: int, fitting: dict[str, int], tolerance: float) -> str:
    """The first type that fits enough of a column's values; text where none does, or where there are none."""
    return next((name for name, n in fitting.items() if held and n >= held * (1 - tolerance)), "string")


def infer_csv(spark: SparkSession, paths: list[str], options: dict[str, str], tolerance: float = 0.0,
              provenance: bool = False) -> DataFrame:
    """The rows of CSV files with a header, each column of its inferred type.

    With ``tolerance`` they also have ``unfit``: a map from column to text of the values that their column's type cannot hold, NULL where
    all fit.  An empty field is NULL.
    """
    texts = spark.read.options(**options).option("header", True).option("inferSchema", False).csv(paths)
    columns = [f.name for f in texts.schema.fields if isinstance(f.dataType, T.StringType)]  # partition columns have types
    if provenance:
        texts = texts.withColumn("filename", F.col("_metadata.file_path"))
    seen, path = Observation("types"), scratch_dir(spark, "csv")
    counts = [c for at, name in enumerate(columns) for c in (
        F.count(F.col(f"`{name}`")).alias(f"{at}"), *[F.count(read(F.col(f"`{name}`"))).alias(f"{at} {kind}") for kind, read in TYPES.items()])]
    # above a repartition hint, where a plan that turns out empty is still observed
    rows = texts.hint("rebalance")
    (rows.observe(seen, *counts) if counts else rows).write.option("compression", "zstd").parquet(path)
    found = seen.get if counts else {}
    kinds = {name: chosen(found[f"{at}"], {kind: found[f"{at} {kind}"] for kind in TYPES}, tolerance) for at, name in enumerate(columns)}
    stored = spark.read.schema(texts.schema).parquet(path)

    def typed(name: str) -> Column:
        text = F.col(f"`{name}`")
        return (TYPES[kinds[name]](text) if kinds.get(name) in TYPES else text).alias(name)

    out = [typed(name) for name in stored.columns]
    if tolerance:
        odd = [F.when(F.col(f"`{name}`").isNotNull() & TYPES[kinds[name]](F.col(f"`{name}`")).isNull(),
                      F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("text"))) for name in columns if kinds[name] in TYPES]
        pairs = F.array_compact(F.array(*odd)) if odd else F.array().cast("array<struct<column:string,text:string>>")
        out.append(F.when(F.size(pairs) > 0, F.map_from_entries(pairs)).alias(UNFIT))
    return stored.select(out)
