"""The full audit of a status history as one table of judged metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.functions.numbers import ratio
from snapgrid.operators.baseline import mae_of, mae_of_slots, slot_errors, target_pairs_of
from snapgrid.operators.consistency import COUNTS, consistency_of
from snapgrid.operators.coverage import cadence, cadence_summary, keys_amplitude, keys_gone, keys_per_day, volume_of
from snapgrid.operators.daystate import ages_of, buckets_of, day_state, runs_of, stations_of
from snapgrid.operators.freshness import freshness
from snapgrid.operators.islands import frozen, frozen_agreement
from snapgrid.operators.timegrid import fill_rate_of
from snapgrid.schema import INFO, LANDED_RENAMES, STATUS, canonicalise
from snapgrid.session import located, scratch_dir
from snapgrid.sources.readers import read_snapshots
from snapgrid.sources.sinks import write_report

# The three verdicts, and the two of the frozen-sensor comparison.
GOOD, WATCH, BAD = "OK", "à surveiller", "PROBLÈME"
AGREE, DIVERGE = "les deux signaux se recoupent", "signaux divergents, à creuser"


@dataclass(frozen=True)
class Limit:
    """A metric is good beyond ``ok`` in the direction of ``op``, to be watched beyond ``watch``.

    ``op`` is "<" or ">"; ``exact`` asks for equality with ``ok`` instead.
    """

    metric: str
    op: str
    ok: float
    watch: float | None = None
    exact: bool = False
    labels: tuple[str, str, str] = (GOOD, WATCH, BAD)

    def verdict(self, value: Column) -> Column:
        """Verdict of a value; NULL compares as false and is therefore bad."""
        def beyond(bound: float) -> Column:
            return value < bound if self.op == "<" else value > bound

        good, watch, bad = self.labels
        result = F.when(value == self.ok if self.exact else beyond(self.ok), good)
        if self.watch is not None:
            result = result.when(beyond(self.watch), watch)
        return result.otherwise(bad)


# The limits metrics are judged by.
LIMITS = [
    Limit("taux_collecte", ">", 0.97, 0.90),
    Limit("pire_trou_min", "<", 45, 180),
    Limit("amplitude", "<", 15, 100),
    Limit("n_absentes", "<", 0, 30, exact=True),
    Limit("pct_sup_24h", "<", 1, 5),
    Limit("part_nulls_bikes", "<", 0.01),
    Limit("part_types_incoherents", "<", 0.005, 0.05),
    Limit("negatifs", "<", 0, exact=True),
    Limit("part_depasse_capacite", "<", 0.01, 0.05),
    Limit("accord", ">", 0.7, labels=(AGREE, DIVERGE, DIVERGE)),
    Limit("pct_remplies", ">", 95, 85),
]


def verdicts(metrics: DataFrame, limits: Sequence[Limit] = LIMITS) -> DataFrame:
    """Add a verdict to ``(section, metric, value)`` rows; NULL where no limit is set."""
    judged = F.lit(None).cast("string")
    for limit in limits:
        judged = F.when(F.col("metric") == limit.metric, limit.verdict(F.col("value"))).otherwise(judged)
    return metrics.select("section", "metric", "value", judged.alias("verdict"))


def _long(section: str, row: DataFrame, names: Sequence[str]) -> DataFrame:
    """A one-row table as one (section, metric, value) row per column."""
    pairs = ", ".join(f"'{name}', CAST(`{name}` AS DOUBLE)" for name in names)
    return row.select(F.lit(section).alias("section"), F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))


def _state(status: DataFrame, step_min: int) -> DataFrame:
    """The state of all days in the shared scratch folder, so that its consumers do not read the history again."""
    path = scratch_dir(status.sparkSession, "audit-state")
    day_state(status, step_min).write.partitionBy("kind").parquet(path)
    return status.sparkSession.read.parquet(path)


def audit_metrics(status: DataFrame, info: DataFrame | None = None, step_min: int = 15,
                  horizon_min: int = 60, tz: str = "Europe/Paris", ties: Sequence[str] = (),
                  slice_min: int = 10, unique: bool = False, state: DataFrame | None = None) -> DataFrame:
    """Every figure of the audit as ``(section, metric, value)``.

    ``unique`` says that no (station, time) has two rows, which saves a shuffle; ``slice_min`` is the length of the slices
    that frozen sensors are looked for in.  ``state`` is the stored :func:`snapgrid.operators.daystate.day_state` of the same
    rows and step; without one it is made here.

    ``status`` is read three times at most: for the state, for the rows around the age quantiles, and for the islands.  All
    other sections read the state.
    """
    state = _state(status, step_min) if state is None else state
    runs, seen, buckets = runs_of(state), stations_of(state), buckets_of(state)
    stations = keys_amplitude(keys_per_day(seen)).crossJoin(F.broadcast(keys_gone(seen)))

    counts = [c for c in COUNTS if c != "n" and (info is not None or c != "depasse_capacite")]
    shares = {f"part_{c}": ratio(F.col(c), F.col("n")) for c in counts}
    values = consistency_of(seen, info, ties).withColumns(shares)

    agreement = frozen_agreement(frozen(status, slice_min=slice_min, unique=unique)).withColumnRenamed("n_stations", "n_stations_6h")
    errors = slot_errors(target_pairs_of(buckets, runs, step_min, horizon_min, tz))
    by_slot = mae_of_slots(errors).select(
        F.lit("baseline").alias("section"), F.concat(F.lit("mae "), "creneau").alias("metric"),
        F.col("mae").alias("value"))

    sections = [
        _long("volume", volume_of(runs, seen, step_min),
              ["n_lignes", "n_runs", "n_stations", "jours", "runs_attendus", "taux_collecte"]),
        _long("cadence", cadence_summary(cadence(runs, step_min)), ["pire_trou_min", "runs_manques"]),
        _long("referentiel", stations, ["amplitude", "n_absentes"]),
        _long("fraicheur", freshness(status, counts=ages_of(state)),
              ["p50_s", "p90_min", "p99_h", "max_h", "pct_sup_6h", "pct_sup_24h"]),
        _long("coherence", values, [*counts, *shares]),
        _long("figes", agreement, ["n_stations_6h", "accord"]),
        _long("grille", fill_rate_of(buckets, runs, step_min), ["cases", "pct_remplies"]),
        _long("baseline", mae_of(errors), ["mae"]),
        by_slot,
    ]
    return reduce(DataFrame.unionByName, sections)


def audit(status: DataFrame, info: DataFrame | None = None, step_min: int = 15,
          horizon_min: int = 60, tz: str = "Europe/Paris", ties: Sequence[str] = (),
          slice_min: int = 10, unique: bool = False, state: DataFrame | None = None) -> DataFrame:
    """Audit report: ``(section, metric, value, verdict)``."""
    return verdicts(audit_metrics(status, info, step_min, horizon_min, tz, ties, slice_min, unique, state))


def run_audit(spark: SparkSession, status: str, dest: str, info: str | None = None, *, start: str | None = None,
              end: str | None = None, step_min: int = 15, tz: str = "Europe/Paris", fmt: str = "parquet",
              slice_min: int = 10, unique: bool = False) -> None:
    """Audit stored snapshots and store the report.

    ``status`` and ``info`` are Parquet folders or globs; their columns are
    brought to the canonical ones first.  Of reference rows at one instant the greatest capacity counts.
    """
    history = canonicalise(read_snapshots(spark, status, ".parquet", start=start, end=end), STATUS, LANDED_RENAMES)
    reference = None if info is None else canonicalise(read_snapshots(spark, info, ".parquet"), INFO, LANDED_RENAMES)
    report = audit(history, reference, step_min, tz=tz, ties=["capacity"], slice_min=slice_min, unique=unique)
    write_report(report.coalesce(1), located(dest), fmt)
