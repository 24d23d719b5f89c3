"""Profile of every dataset below a folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from snapgrid.operators.envelope import flatten_envelope, stations_path
from snapgrid.operators.profile import bounds, conformance, describe, preview
from snapgrid.sources.discover import discover
from snapgrid.sources.readers import read_snapshots


@dataclass(frozen=True)
class Profile:
    """What one dataset holds; ``conformance`` only where there are bike counts.

    ``flattened`` says that station lists were unnested for the profile, and
    ``error`` why a dataset could not be read.
    """

    dataset: str
    ext: str
    n_files: int
    bytes: int
    flattened: bool = False
    columns: DataFrame | None = None
    bounds: DataFrame | None = None
    preview: DataFrame | None = None
    conformance: DataFrame | None = None
    error: str | None = None


def inspect_tree(spark: SparkSession, root: str) -> list[Profile]:
    """Profile each dataset found below ``root``; their number is that of folders, not of files."""
    profiles = []
    for found in discover(spark, root).orderBy("dataset", "ext").collect():
        base = root.rstrip("/") if found["dataset"] == "." else f"{root.rstrip('/')}/{found['dataset']}"
        try:
            raw = read_snapshots(spark, f"{base}/**/*{found['ext']}")
        except (AnalysisException, ValueError) as error:
            profiles.append(Profile(**found.asDict(), error=str(error).splitlines()[0]))
            continue
        df = flatten_envelope(raw)
        profiles.append(Profile(
            **found.asDict(), flattened=stations_path(raw.schema) is not None, columns=describe(df),
            bounds=bounds(df), preview=preview(df),
            conformance=conformance(df) if "num_bikes_available" in df.columns else None))
    return profiles
