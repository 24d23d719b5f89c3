"""SQL for each registered query, by another method than the operator's.

Predecessors come from ASOF joins, islands from their change points, quantiles from positions in the sorted list, the grid
from set differences, later values from each station's list of cells, shifted by one horizon.
"""

from __future__ import annotations

from snapgrid.operators.baseline import LAST_SLOT, SLOTS
from snapgrid.plans.audit import LIMITS, Limit
from snapgrid.schema import OPTIONAL, REQUIRED

STATUS = """
e AS (SELECT event_id, ts, user_id, value, event_type,
             CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events),
b AS (SELECT *, CASE WHEN event_type = 'error' AND k % 10 = 0 THEN NULL
                     ELSE CAST(floor(value / 20) AS INTEGER) END AS nba FROM e),
status AS (
  SELECT event_id, user_id AS station_id, ts AS fetched_at,
         ts - to_microseconds(CAST(k AS BIGINT) * k * k * 100000) AS last_reported,
         nba AS num_bikes_available,
         nba - nba % 3 + CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END AS mechanical,
         nba % 3 AS ebike, 20 - nba AS num_docks_available,
         k % 50 <> 0 AS is_renting, k % 97 <> 0 AS is_installed
  FROM b)"""

# A history with NULL times and stations; some stations have no time at all.
GAPPY = STATUS.replace("\nstatus AS", "\nwhole AS") + """,
status AS (SELECT * REPLACE (CASE WHEN event_id % 11 = 0 OR station_id % 10 = 7 THEN NULL ELSE fetched_at END AS fetched_at,
                             CASE WHEN event_id % 13 = 0 THEN NULL ELSE station_id END AS station_id) FROM whole)"""

INFO = """
info AS (SELECT o_custkey AS station_id, o_orderdate AS fetched_at, o_orderkey AS snap_id,
                CAST(floor(o_totalprice) AS BIGINT) % 40 AS capacity FROM orders),
ref_stations AS (
  SELECT * FROM info i WHERE NOT EXISTS (
    SELECT 1 FROM info j WHERE j.station_id = i.station_id
       AND (j.fetched_at > i.fetched_at OR (j.fetched_at = i.fetched_at AND j.snap_id > i.snap_id))))"""

RUNS = """
run_status AS (SELECT * REPLACE (time_bucket(INTERVAL 15 MINUTE, fetched_at) AS fetched_at) FROM status)"""


def _cadence(source: str, step: int = 15) -> str:
    """Each run looks its predecessor up; the median is the mean of the two middle gaps of the sorted list."""
    return f"""
instants AS (SELECT fetched_at AS moment FROM {source} GROUP BY moment),
stretches AS (SELECT later.moment, epoch_us(later.moment) - epoch_us(earlier.moment) AS us
              FROM instants later ASOF LEFT JOIN instants earlier ON later.moment > earlier.moment),
per_day AS (SELECT CAST(moment AS DATE) AS jour, count(*) AS runs, list_sort(list(us) FILTER (us IS NOT NULL)) AS sorted
            FROM stretches GROUP BY jour),
cadence AS (
  SELECT jour, runs,
         round((sorted[(len(sorted) + 1) // 2] + sorted[len(sorted) // 2 + 1]) / 2 / 60e6, 1) AS ecart_median_min,
         round(sorted[-1] / 60e6, 1) AS pire_trou_min,
         coalesce(len(list_filter(sorted, lambda us: us > {step * 90_000_000})), 0) AS runs_manques
  FROM per_day)"""


VOLUME = """
by_instant AS (SELECT fetched_at AS moment, count(*) AS n FROM status GROUP BY moment),
period AS (SELECT CAST(sum(n) AS BIGINT) AS n_lignes, count(moment) AS n_runs, min(moment) AS debut, max(moment) AS fin FROM by_instant),
length AS (SELECT *, (SELECT count(station_id) FROM (SELECT station_id FROM status GROUP BY station_id)) AS n_stations,
                  (epoch_us(fin) - epoch_us(debut)) / 86400e6 AS jours FROM period),
volume AS (SELECT *, jours * 96 AS runs_attendus, coalesce(n_runs / nullif(jours * 96, 0), 0) AS taux_collecte FROM length)"""

DAYS = """
stations_daily AS (SELECT jour, count(station_id) AS n_stations
                   FROM (SELECT DISTINCT CAST(fetched_at AS DATE) AS jour, station_id FROM status) GROUP BY jour)"""

GONE = """
gone AS (SELECT count(*) AS n_absentes FROM (
  SELECT station_id FROM status WHERE fetched_at IS NOT NULL
  EXCEPT SELECT station_id FROM status WHERE fetched_at >= (SELECT max(fetched_at) FROM status) - INTERVAL 12 HOUR))"""


def _at(share: float) -> str:
    """Value at a share of the sorted list, between two neighbours in proportion."""
    place = f"({share}::DOUBLE * (len(ages) - 1))"
    low, high = f"ages[CAST(floor({place}) AS BIGINT) + 1]", f"ages[CAST(ceil({place}) AS BIGINT) + 1]"
    return f"({low} + ({high} - {low}) * ({place} - floor({place}))) / 1e6"


FRESHNESS = f"""
aged AS (SELECT epoch_us(fetched_at) - epoch_us(last_reported) AS us FROM status),
older AS (SELECT list_sort(list(us)) AS ages, avg(CAST(us > 6 * 3600e6 AS INTEGER)) AS beyond_6,
                 avg(CAST(us > 24 * 3600e6 AS INTEGER)) AS beyond_24 FROM aged WHERE us IS NOT NULL),
freshness AS (
  SELECT round({_at(0.5)}) AS p50_s, round({_at(0.9)} / 60) AS p90_min, round({_at(0.99)} / 3600, 1) AS p99_h,
         round(ages[-1] / 3600e6, 1) AS max_h, round(beyond_6 * 100, 2) AS pct_sup_6h,
         round(beyond_24 * 100, 2) AS pct_sup_24h
  FROM older)"""


def _number(where: str, source: str = "status") -> str:
    return f"(SELECT count(*) FROM {source} WHERE {where})"


def _consistency(with_info: bool) -> str:
    """One count over a selection for each figure."""
    beyond = _number("s.num_bikes_available + s.num_docks_available > r.capacity",
                     "status s JOIN ref_stations r ON r.station_id = s.station_id")
    return f"""
consistency AS (
  SELECT {_number('true')} AS n, {_number('num_bikes_available IS NULL')} AS nulls_bikes,
         {_number('num_bikes_available - mechanical - ebike <> 0')} AS types_incoherents,
         {_number('least(num_bikes_available, num_docks_available) < 0')} AS negatifs,
         {beyond if with_info else 'CAST(NULL AS BIGINT)'} AS depasse_capacite,
         {_number('is_renting = false')} AS hors_service, {_number('is_installed = false')} AS non_installees)"""


ISLANDS = """
seen AS (SELECT station_id, fetched_at AS moment, min(num_bikes_available) AS low, max(num_bikes_available) AS high,
                count(*) AS n, max(epoch_us(fetched_at) - epoch_us(last_reported)) AS age
         FROM status WHERE num_bikes_available IS NOT NULL GROUP BY ALL),
changes AS (SELECT now.station_id, now.moment AS debut
            FROM seen now ASOF LEFT JOIN seen past ON past.station_id = now.station_id AND now.moment > past.moment
            WHERE past.high IS NULL OR past.high <> now.low OR now.low <> now.high),
islands AS (SELECT changes.station_id, debut, min(low) AS valeur, CAST(sum(n) AS BIGINT) AS n_obs, max(moment) AS fin,
                   (epoch_us(max(moment)) - epoch_us(debut)) / 3600e6 AS duree_h, max(age) / 3600e6 AS fraicheur_max_h
            FROM seen ASOF JOIN changes ON changes.station_id = seen.station_id AND seen.moment >= changes.debut
            GROUP BY changes.station_id, debut),
frozen AS (SELECT hours AS seuil_heures, count(*) AS n_plages, count(DISTINCT station_id) AS n_stations,
                  CAST(count_if(fraicheur_max_h > 6) AS BIGINT) AS dont_fraicheur_confirme
           FROM islands JOIN (VALUES (3), (6), (12), (24)) levels(hours) ON duree_h >= hours GROUP BY hours)"""


def _grid(step: int = 15) -> str:
    """Cells that hold a value, and all others as what the set of cells has beyond them."""
    steps_ahead = 60 // step
    ahead = f"to_minutes({steps_ahead * step})"
    shifted = "list_resize({}, len(held))"
    return f"""
obs AS (SELECT station_id, time_bucket(INTERVAL {step} MINUTE, fetched_at) AS ts,
               arg_max_null(num_bikes_available, fetched_at) AS n_bikes
        FROM status WHERE fetched_at IS NOT NULL GROUP BY ALL),
origin AS (SELECT date_trunc('hour', min(fetched_at)) AS t0, max(fetched_at) AS t1 FROM status),
steps AS (SELECT t0 + to_minutes({step} * i) AS ts
          FROM (SELECT t0, unnest(range((epoch_us(t1) - epoch_us(t0)) // {step * 60_000_000} + 1)) AS i FROM origin)),
cells AS (SELECT station_id, ts FROM (SELECT station_id FROM status GROUP BY station_id), steps),
filled AS (SELECT station_id, ts, n_bikes FROM obs
           WHERE n_bikes IS NOT NULL AND station_id IS NOT NULL AND ts IN (SELECT ts FROM steps)),
grid AS (SELECT station_id, ts, n_bikes, false AS is_imputed FROM filled
         UNION ALL
         SELECT station_id, ts, NULL, true FROM (FROM cells EXCEPT SELECT station_id, ts FROM filled)),
series AS (SELECT c.station_id, list(c.ts ORDER BY c.ts) AS at_ts, list(n_bikes ORDER BY c.ts) AS held
           FROM cells c LEFT JOIN filled f ON f.station_id = c.station_id AND f.ts = c.ts GROUP BY c.station_id),
target AS (SELECT *, n_bikes IS NULL AS is_imputed, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris') AS h_paris
           FROM (SELECT station_id, unnest(at_ts) AS ts, unnest(held) AS n_bikes,
                        unnest({shifted.format(f"held[{steps_ahead + 1}:]")}) AS y,
                        unnest({shifted.format(f"[x IS NULL FOR x IN held[{steps_ahead + 1}:]]")}) AS y_imputed FROM series)),
pairs AS (SELECT here.station_id, here.ts, here.n_bikes, false AS is_imputed, later.n_bikes AS y, false AS y_imputed,
                 hour((here.ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris') AS h_paris
          FROM filled here JOIN filled later ON later.station_id = here.station_id AND later.ts = here.ts + {ahead})"""


FILL = """
fill AS (SELECT cases, round(100 * n / cases, 2) AS pct_remplies
         FROM (SELECT (SELECT count(*) FROM cells) AS cases, (SELECT count(*) FROM filled)::DOUBLE AS n))"""

HOLES = """SELECT station_id, round(100 - 100 * count(n_bikes)::DOUBLE / count(*), 1) AS pct_trous
  FROM grid GROUP BY station_id ORDER BY pct_trous DESC, station_id NULLS LAST LIMIT 5"""


def _by_slot(hour: str = "h_paris") -> str:
    slots = ", ".join(f"({low}, {high}, '{label}')" for low, high, label in SLOTS)
    return f"""
by_slot AS (SELECT coalesce(label, '{LAST_SLOT}') AS creneau, count(*) AS n,
                   round(sum(greatest(n_bikes, y) - least(n_bikes, y)) / count(*), 3) AS mae
            FROM pairs LEFT JOIN (VALUES {slots}) slots(low, high, label) ON {hour} BETWEEN low AND high
            GROUP BY label)"""


MAE = "round(sum(greatest(n_bikes, y) - least(n_bikes, y)) / count(*), 3) AS mae"


def _metric(section: str, source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}"
        for name, value in ((n.split("=")[0], n.split("=")[-1]) for n in names))


METRICS = "metrics AS (" + " UNION ALL ".join([
    _metric("volume", "volume", ["n_lignes", "n_runs", "n_stations", "jours", "runs_attendus", "taux_collecte"]),
    _metric("cadence", "(SELECT max(pire_trou_min) AS pire_trou_min, sum(runs_manques) AS runs_manques FROM cadence)",
            ["pire_trou_min", "runs_manques"]),
    _metric("referentiel", "(SELECT max(n_stations) - min(n_stations) AS amplitude FROM stations_daily)",
            ["amplitude"]),
    _metric("referentiel", "gone", ["n_absentes"]),
    _metric("fraicheur", "freshness", ["p50_s", "p90_min", "p99_h", "max_h", "pct_sup_6h", "pct_sup_24h"]),
    _metric("coherence", "consistency", [
        x for c in ("nulls_bikes", "types_incoherents", "negatifs", "depasse_capacite", "hors_service",
                    "non_installees") for x in (c, f"part_{c}={c}::DOUBLE / n")]),
    _metric("figes", "(SELECT * FROM frozen WHERE seuil_heures = 6)",
            ["n_stations_6h=n_stations", "accord=dont_fraicheur_confirme::DOUBLE / n_plages"]),
    _metric("grille", "fill", ["cases", "pct_remplies"]),
    _metric("baseline", f"(SELECT {MAE} FROM pairs)", ["mae"]),
    "SELECT 'baseline', 'mae ' || creneau, mae FROM by_slot",
]) + ")"


def _judged(limit: Limit) -> str:
    """The limits themselves are fixed values, kept in one place."""
    good, watch, bad = (f"'{label}'" for label in limit.labels)
    op = "=" if limit.exact else limit.op
    between = f" WHEN value {limit.op} {limit.watch} THEN {watch}" if limit.watch is not None else ""
    return f"WHEN '{limit.metric}' THEN CASE WHEN value {op} {limit.ok} THEN {good}{between} ELSE {bad} END"


VERDICT = "CASE metric " + " ".join(map(_judged, LIMITS)) + " END"

# A history with copies and values out of range, a grid with lost and repeated cells, a target filled at its end.
DAMAGE = """
copied AS (SELECT * REPLACE (CASE WHEN event_id % 70 = 3 THEN 200 ELSE num_bikes_available END AS num_bikes_available)
           FROM (FROM status UNION ALL (FROM status WHERE event_id % 50 = 0))),
torn AS (SELECT station_id, ts FROM grid WHERE station_id % 7 <> 3 OR hour(ts) <> 5),
closing AS (SELECT count(*) AS n FROM target, (SELECT max(ts) AS fin FROM steps)
            WHERE ts > fin - INTERVAL 1 HOUR AND station_id % 5 = 1)"""

# The nested feed, straight from the flat table: first listed type wins and defaults to 0,
# or the last listed wins and stays NULL.
FEED = """
f AS (SELECT event_id, ts, user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k,
             CAST(floor(value / 20) AS INTEGER) AS nba, date_trunc('day', ts) AS run FROM events),
first_wins AS (
  SELECT event_id AS station_id, CAST(user_id AS VARCHAR) AS "stationCode",
         nba AS num_bikes_available, 20 - nba AS num_docks_available,
         CASE WHEN k % 10 = 0 THEN 0 WHEN k % 7 = 0 THEN nba ELSE nba - nba % 3 END AS mechanical,
         CASE WHEN k % 10 = 0 THEN 0 WHEN k % 7 = 0 THEN 0 ELSE nba % 3 END AS ebike,
         k % 97 <> 0 AS is_installed, k % 50 <> 0 AS is_renting, true AS is_returning,
         date_trunc('second', ts) AS last_reported, run AS fetched_at, CAST(run AS DATE) AS date
  FROM f),
last_wins AS (
  SELECT event_id AS station_id, CAST(user_id AS VARCHAR) AS "stationCode",
         CASE WHEN k % 10 = 0 THEN NULL WHEN k % 7 = 0 THEN nba + 1 ELSE nba - nba % 3 END AS mechanical,
         CASE WHEN k % 10 = 0 OR k % 7 = 0 THEN NULL ELSE nba % 3 END AS ebike
  FROM f)"""


# The names are fixed values, kept in one place; which of them exist is asked of the engine's catalogue.
CONFORMANCE = f"""
present AS (SELECT column_name AS name FROM (DESCRIBE status)),
wanted AS (FROM (VALUES {", ".join(f"('required', '{c}')" for c in REQUIRED)},
                        {", ".join(f"('optional', '{c}')" for c in OPTIONAL)}, ('time_axis', 'fetched_at')) w(kind, name)),
findings AS (SELECT kind, name, name IN (FROM present) AS ok FROM wanted
             UNION ALL SELECT 'usable', NULL, bool_and(name IN (FROM present)) FROM wanted WHERE kind = 'required')"""


# The nested rows themselves, cast to text by the engine.
NESTED = """
kinds AS (SELECT event_id, ts, user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k, CAST(floor(value / 20) AS INTEGER) AS nba
          FROM events),
nested AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS run, event_id, struct_pack(
    station_id := event_id, "stationCode" := user_id::VARCHAR, num_bikes_available := nba, num_docks_available := 20 - nba,
    num_bikes_available_types := CASE WHEN k % 10 = 0 THEN []::STRUCT(mechanical INTEGER, ebike INTEGER)[]
      WHEN k % 7 = 0 THEN [{'mechanical': nba, 'ebike': NULL::INTEGER}, {'mechanical': nba + 1, 'ebike': NULL::INTEGER}]
      ELSE [{'mechanical': nba - nba % 3, 'ebike': NULL::INTEGER}, {'mechanical': NULL::INTEGER, 'ebike': nba % 3}] END,
    is_installed := (k % 97 <> 0)::INTEGER, is_renting := (k % 50 <> 0)::INTEGER, is_returning := 1,
    last_reported := epoch_us(ts) // 1000000) AS station
  FROM kinds ORDER BY event_id LIMIT 3)"""


def _preview(width: int) -> str:
    cut = ", ".join(f"left({c}::VARCHAR, {width}) AS {c}" for c in ("run", "event_id", "station"))
    return _with(NESTED) + f"SELECT {cut} FROM nested"


_SHARES = " UNION ALL ".join(
    f"SELECT 'coherence' AS section, 'part_{c}' AS metric, round({c}::DOUBLE / n, 6) AS value FROM consistency"
    for c in ("nulls_bikes", "types_incoherents", "negatifs", "depasse_capacite", "hors_service", "non_installees"))


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


_GRID = (STATUS, _grid())
_PAIR_COLUMNS = "station_id, ts, n_bikes, is_imputed, y, y_imputed, h_paris"

_VERDICTS = (_with(STATUS, RUNS, INFO, VOLUME, _cadence("status"), DAYS, GONE, FRESHNESS, _consistency(True),
                  ISLANDS, _grid(), FILL, _by_slot(), METRICS)
             + f"SELECT section, metric, round(value, 6) AS value, {VERDICT} AS verdict FROM metrics")

# The exact figures; that estimates are near them is what the query says of each.
_SKETCHED = """, exact AS (
    SELECT 'volume' AS section, NULL::DATE AS jour, unnest(['n_runs', 'n_stations']) AS metric,
           unnest([n_runs, n_stations])::DOUBLE AS value FROM volume
    UNION ALL SELECT 'freshness', NULL, unnest(['p50_s', 'p90_min', 'p99_h', 'max_h', 'pct_sup_6h', 'pct_sup_24h']),
           unnest([p50_s, p90_min, p99_h, max_h, pct_sup_6h, pct_sup_24h]) FROM freshness
    UNION ALL SELECT 'stations_daily', jour, 'n_stations', n_stations::DOUBLE FROM stations_daily)
    SELECT section, form, jour, metric, value, true AS near FROM exact, (VALUES ('merged'), ('direct')) forms(form)"""

ORACLE = {
    "volume_coverage": _with(STATUS, VOLUME) + """SELECT n_lignes, n_runs, n_stations, debut, fin,
        round(jours, 6) AS jours, round(runs_attendus, 6) AS runs_attendus,
        round(taux_collecte, 6) AS taux_collecte FROM volume""",
    "cadence_daily": _with(STATUS, RUNS, _cadence("run_status")) + "SELECT * FROM cadence ORDER BY jour",
    "cadence_daily_events": _with(STATUS, _cadence("status")) + "SELECT * FROM cadence ORDER BY jour",
    "cadence_daily_nulls": _with(GAPPY, _cadence("status")) + "SELECT * FROM cadence ORDER BY jour",
    "cadence_total": _with(STATUS, RUNS, _cadence("run_status")) + """SELECT max(pire_trou_min) AS pire_trou_min,
        CAST(sum(runs_manques) AS BIGINT) AS runs_manques FROM cadence""",
    "stations_daily": _with(STATUS, DAYS) + "SELECT * FROM stations_daily ORDER BY jour",
    "stations_amplitude": _with(STATUS, DAYS)
    + "SELECT max(n_stations) - min(n_stations) AS amplitude FROM stations_daily",
    "stations_gone": _with(STATUS, GONE) + "SELECT * FROM gone",
    "freshness": _with(STATUS, FRESHNESS) + "SELECT * FROM freshness",
    "consistency": _with(STATUS, INFO, _consistency(True)) + "SELECT * FROM consistency",
    "consistency_no_reference": _with(STATUS, _consistency(False)) + "SELECT * FROM consistency",
    "frozen_sensors": _with(STATUS, ISLANDS) + "SELECT * FROM frozen ORDER BY seuil_heures",
    "frozen_agreement": _with(STATUS, ISLANDS) + """SELECT n_stations,
        round(dont_fraicheur_confirme::DOUBLE / n_plages, 6) AS accord FROM frozen WHERE seuil_heures = 6""",
    "islands": _with(STATUS, ISLANDS) + """SELECT station_id, valeur, n_obs, debut, fin,
        round(duree_h, 6) AS duree_h, round(fraicheur_max_h, 6) AS fraicheur_max_h FROM islands""",
    "latest_reference": _with(INFO) + "SELECT * FROM ref_stations",
    "obs_latest_per_bucket": _with(*_GRID) + "SELECT * FROM obs",
    "grid_cells": _with(*_GRID) + "SELECT * FROM grid",
    "grid_cells_nulls": _with(GAPPY, _grid()) + "SELECT * FROM grid",
    "grid_fill": _with(*_GRID, FILL) + "SELECT * FROM fill",
    "grid_fill_nulls": _with(GAPPY, _grid(), FILL) + "SELECT * FROM fill",
    "grid_fill_25min": _with(STATUS, _grid(25), FILL) + "SELECT * FROM fill",
    "worst_holes_top5": _with(*_GRID) + HOLES,
    "worst_holes_nulls": _with(GAPPY, _grid()) + HOLES,
    "target_cells": _with(*_GRID) + f"SELECT {_PAIR_COLUMNS} FROM target",
    "target_stored_grid": _with(*_GRID) + f"SELECT {_PAIR_COLUMNS} FROM target",
    "target_cells_nulls": _with(GAPPY, _grid()) + f"SELECT {_PAIR_COLUMNS} FROM target",
    "target_pairs": _with(*_GRID) + f"SELECT {_PAIR_COLUMNS} FROM pairs",
    "target_pairs_nulls": _with(GAPPY, _grid()) + f"SELECT {_PAIR_COLUMNS} FROM pairs",
    "grid_fill_45min": _with(STATUS, _grid(45), FILL) + "SELECT * FROM fill",
    "target_pairs_45min": _with(STATUS, _grid(45)) + f"SELECT {_PAIR_COLUMNS} FROM pairs",
    "mae_overall": _with(*_GRID) + f"SELECT {MAE} FROM pairs",
    "mae_by_slot": _with(*_GRID, _by_slot()) + "SELECT * FROM by_slot ORDER BY creneau",
    "mae_by_slot_fixed_offset": _with(*_GRID, _by_slot("hour(ts + INTERVAL 2 HOUR)"))
    + "SELECT * FROM by_slot ORDER BY creneau",
    "verdicts": _VERDICTS,
    "verdicts_by_days": _VERDICTS,
    "sketched_figures": _with(STATUS, VOLUME, DAYS, FRESHNESS).rstrip() + _SKETCHED,
    "dq_checks": _with(*_GRID, DAMAGE) + """
        SELECT 'duplicate_key' AS "check", count(*) AS n_violations
        FROM (SELECT station_id, fetched_at FROM copied GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'value_range', count(*) FROM copied WHERE num_bikes_available > 100 OR num_bikes_available < 0
        UNION ALL SELECT 'grid_hole', count(*) FROM (FROM cells EXCEPT FROM torn)
        UNION ALL SELECT 'late_target', n FROM closing""",
    "envelope_flatten": _with(FEED) + "SELECT * FROM first_wins",
    "type_merge_last_wins": _with(FEED) + "SELECT * FROM last_wins",
    "landed_snapshots": _with(FEED) + """SELECT l.station_id, mechanical, ebike, run AS ingested_at
        FROM last_wins l JOIN f ON f.event_id = l.station_id""",
    "land_two_runs": _with(FEED) + """SELECT l.station_id, mechanical, ebike, run AS ingested_at
        FROM last_wins l JOIN f ON f.event_id = l.station_id""",
    "convert_roundtrip": _with(FEED) + "SELECT * FROM first_wins",
    "stream_ingest": _with(FEED) + "SELECT * FROM first_wins",
    "stream_repeated": _with(FEED) + "SELECT * FROM first_wins",
    "stamp_from_filename": """
        SELECT event_id, 'raw/status/date=' || strftime(ts, '%Y-%m-%d') || '/' || strftime(ts, '%Y%m%dT%H%M%S') || 'Z.json'
               AS filename, date_trunc('second', ts) AS fetched_at FROM events""",
    "profile_bounds": _with(STATUS, VOLUME) + "SELECT n_lignes, debut, fin, n_runs, n_stations FROM length",
    "schema_describe": """
        SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column",
               CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
                    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type,
               (SELECT count(*) FROM events) AS n_lignes
        FROM information_schema.columns WHERE table_name = 'events'""",
    "schema_conformance": _with(STATUS, CONFORMANCE) + """
        SELECT kind AS "check", name AS "column", ok, (SELECT count(*) FROM status) AS n_lignes FROM findings""",
    "csv_json_roundtrip": " UNION ALL ".join(
        f"SELECT '{ext}' AS ext, event_id, ts, user_id, event_type, value, props FROM events"
        for ext in (".csv", ".ndjson", ".gz", ".parquet")),
    "union_by_name": """
        SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, CASE WHEN event_id % 2 = 0 THEN value END AS value,
               CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type FROM events""",
    "json_multiline_inferred": _with(FEED) + "SELECT * FROM first_wins",
    "csv_inferred": """
        SELECT event_id, ts, ts::DATE AS day, user_id, event_type, CASE WHEN event_id % 1000 <> 999 THEN value END AS value, props,
               user_id % 2 = 0 AS even, CASE WHEN event_id % 1000 = 999 THEN 'unknown' END AS unfit_value,
               CASE WHEN event_id % 1000 = 999 THEN 1 ELSE 0 END AS n_unfit FROM events""",
    "union_by_name_wide": """
        WITH e AS (SELECT *, round(value * 100)::BIGINT AS cents, event_id % 3 AS part FROM events)
        SELECT event_id, CASE part WHEN 2 THEN round(cents / 1000, 3)::DECIMAL(22, 3) ELSE cents::DECIMAL(22, 3) END::VARCHAR AS amount,
               CASE part WHEN 0 THEN (user_id % 2 = 0)::INTEGER WHEN 1 THEN (user_id % 7)::INTEGER ELSE (user_id % 3)::INTEGER END AS flag,
               user_id::DOUBLE AS pair_user, CASE WHEN part <> 1 THEN cents::INTEGER END AS pair_cents,
               CASE WHEN part = 1 THEN event_id % 5 END AS five,
               CASE part WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN event_id / 2 END AS first,
               'decimal(22,3)' AS amount_type, 'int' AS flag_type
        FROM e""",
    "preview_nested": _preview(34),
    "preview_nested_whole": _preview(1000),
    "discover_counted": """
        SELECT 'status' AS dataset, '.json' AS ext, count(DISTINCT ts::DATE) AS n_files, true AS has_bytes FROM events
        UNION ALL SELECT 'information', '.parquet', 1, true""",
    "report_stored": _with(STATUS, INFO, _consistency(True))
    + f"SELECT fmt, section, metric, value, {VERDICT} AS verdict FROM ({_SHARES}), (VALUES ('parquet'), ('json'), ('csv')) f(fmt)",
}
