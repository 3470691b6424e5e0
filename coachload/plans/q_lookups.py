"""Registered lookup-build queries (L1-L14, S4, S5) and their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from coachload.operators import lookups as lk
from coachload.plans import sqlparts as sq
from coachload.session import scratch_path
from coachload.sources import tables

SAMPLE_STATION = "NATION_0"   # a station name present in the driver's nation table


def _legs(spark, sf_dir):
    return tables.legs(spark, sf_dir)


def _codes(spark, sf_dir):
    return tables.clean_codes(tables.tiplocs(spark, sf_dir))


# Columns of the legs that the lookup set is built from.
LOOKUP_LEGS = ["stationName_from", "stationLocation_from", "stationName_to", "stationLocation_to", "headcode", "rsid",
               "leg_departure_dt", "coach_type", "vehicle_capacity", *[src for src, _ in lk.HIST_AVERAGES]]


def lookup_set(spark, sf_dir, with_timestamp=False):
    """The set of a deployment with stored legs: they are derived once."""
    return lk.build_lookups(tables.stored_legs(spark, sf_dir, LOOKUP_LEGS), _codes(spark, sf_dir), with_timestamp)


def q_codes(spark, sf_dir):
    return lk.dedup_codes(_codes(spark, sf_dir))


def q_locations(spark, sf_dir):
    return lk.station_locations(_legs(spark, sf_dir))


def q_consolidated(spark, sf_dir):
    return lk.consolidate(lk.station_locations(_legs(spark, sf_dir)))


def q_stations(spark, sf_dir):
    return lk.build_stations(_legs(spark, sf_dir), _codes(spark, sf_dir), keep_source=True)


def q_report(spark, sf_dir):
    return lk.match_report(q_stations(spark, sf_dir))


def q_routes(spark, sf_dir):
    return lk.service_routes(_legs(spark, sf_dir))


def q_hist(spark, sf_dir):
    h = lk.historical_averages(_legs(spark, sf_dir))
    return h.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") else c for c in h.columns])


def q_coach(spark, sf_dir):
    return lk.coach_info(_legs(spark, sf_dir)).withColumn("avg_capacity", F.round("avg_capacity", 6))


def q_metadata(spark, sf_dir):
    return lookup_set(spark, sf_dir)["metadata"]


def q_validation(spark, sf_dir):
    return lk.validate_lookups(lookup_set(spark, sf_dir), SAMPLE_STATION)


def q_written(spark, sf_dir):
    """S3: the lookup set written, read back, and counted."""
    path = f"{scratch_path(spark, 'lookups')}-{uuid.uuid4().hex}"
    lk.write_lookups(lookup_set(spark, sf_dir), path, route_partitions=4)
    out = None
    for name, df in lk.read_lookups(spark, path).items():
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


QUERIES = {
    "lookup_written": q_written,
    "lookup_codes_dedup": q_codes,
    "lookup_station_locations": q_locations,
    "lookup_stations_consolidated": q_consolidated,
    "lookup_stations": q_stations,
    "lookup_match_report": q_report,
    "lookup_service_routes": q_routes,
    "lookup_historical_averages": q_hist,
    "lookup_coach_info": q_coach,
    "lookup_metadata": q_metadata,
    "lookup_validation": q_validation,
}

# --- oracle texts -----------------------------------------------------------
N = sq.normalize
_OK = "({x} IS NOT NULL AND length({x}) > 3)"
CODE_CTES = [
    sq.TIPLOCS_CTE,
    "codes AS (SELECT trim(tiploc_code) AS tiploc, description AS desc_name, tps_description AS tps_desc_name, "
    "crs_code AS crs FROM tiplocs WHERE tiploc_code IS NOT NULL AND trim(tiploc_code) <> '')",
    f"cn AS (SELECT tiploc, {N('desc_name')} AS nd, {N('tps_desc_name')} AS nt, desc_name AS od, "
    "tps_desc_name AS ot, crs FROM codes)",
    "cb AS (SELECT cn.*, CASE "
    f"WHEN {_OK.format(x='nt')} AND {_OK.format(x='nd')} AND length(nt) >= length(nd) - 2 THEN nt "
    f"WHEN {_OK.format(x='nt')} AND {_OK.format(x='nd')} THEN nd "
    f"WHEN {_OK.format(x='nt')} THEN nt WHEN {_OK.format(x='nd')} THEN nd END AS pn FROM cn)",
    "c1 AS (SELECT * FROM cb WHERE pn IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY tiploc "
    "ORDER BY pn, nd NULLS FIRST, nt NULLS FIRST, od NULLS FIRST, ot NULLS FIRST, crs NULLS FIRST) = 1)",
    "c2 AS (SELECT * FROM c1 QUALIFY ROW_NUMBER() OVER (PARTITION BY pn "
    "ORDER BY tiploc, nd NULLS FIRST, nt NULLS FIRST, od NULLS FIRST, ot NULLS FIRST, crs NULLS FIRST) = 1)",
]
STATION_CTES = CODE_CTES + [
    "sl AS (SELECT stationName, stationLocation FROM (SELECT stationName_from AS stationName, "
    "stationLocation_from AS stationLocation FROM legs UNION SELECT stationName_to, stationLocation_to "
    "FROM legs WHERE stationName_to IS NOT NULL) u WHERE stationName IS NOT NULL AND trim(stationName) <> '' "
    "AND stationLocation IS NOT NULL AND trim(stationLocation) <> '')",
    f"sn AS (SELECT {N('stationName')} AS normalized_name, stationName AS station_name, "
    "stationLocation AS station_location FROM sl)",
    "sc AS (SELECT * FROM sn WHERE normalized_name IS NOT NULL QUALIFY ROW_NUMBER() OVER "
    "(PARTITION BY normalized_name ORDER BY station_name, station_location) = 1)",
    "da AS (SELECT * FROM c2 WHERE nd IS NOT NULL AND nd <> pn QUALIFY ROW_NUMBER() OVER (PARTITION BY nd "
    "ORDER BY tiploc, crs NULLS FIRST, od NULLS FIRST, ot NULLS FIRST) = 1)",
    "ta AS (SELECT * FROM c2 WHERE nt IS NOT NULL AND nt <> pn QUALIFY ROW_NUMBER() OVER (PARTITION BY nt "
    "ORDER BY tiploc, crs NULLS FIRST, od NULLS FIRST, ot NULLS FIRST) = 1)",
    "m AS (SELECT sc.*, CASE WHEN p.tiploc IS NOT NULL THEN 'primary' WHEN d.tiploc IS NOT NULL THEN 'description' "
    "WHEN t.tiploc IS NOT NULL THEN 'tps' END AS match_source, "
    + ", ".join(f"COALESCE(p.{a}, CASE WHEN p.tiploc IS NULL THEN COALESCE(d.{a}, CASE WHEN d.tiploc IS NULL "
                f"THEN t.{a} END) END) AS {b}"
                for a, b in (("tiploc", "tiploc"), ("crs", "crs"), ("od", "tiploc_orig_desc"),
                             ("ot", "tiploc_orig_tps_desc")))
    + " FROM sc LEFT JOIN c2 p ON p.pn = sc.normalized_name LEFT JOIN da d ON d.nd = sc.normalized_name "
    "LEFT JOIN ta t ON t.nt = sc.normalized_name)",
    "stations AS (SELECT station_name, "
    "COALESCE(TRY_CAST(CASE WHEN strpos(station_location, ',') > 0 THEN substr(station_location, 1, "
    "strpos(station_location, ',') - 1) ELSE station_location END AS DOUBLE), 54.0) AS latitude, "
    "COALESCE(TRY_CAST(CASE WHEN strpos(station_location, ',') > 0 THEN substr(station_location, "
    "strpos(station_location, ',') + 1) END AS DOUBLE), -2.0) AS longitude, "
    "tiploc, crs, tiploc_orig_desc, tiploc_orig_tps_desc, match_source FROM m)",
]
ROUTES_CTE = (
    f"routes AS (SELECT headcode, rsid, stationName_from, stationName_to, {sq.hour('leg_departure_dt')} AS hour, "
    f"{sq.dow_sunday0('leg_departure_dt')} AS day_of_week, COUNT(*) AS frequency FROM legs "
    "WHERE stationName_from IS NOT NULL AND stationName_to IS NOT NULL AND headcode IS NOT NULL AND rsid IS NOT NULL "
    "GROUP BY ALL)")
_H = sq.hour("leg_departure_dt")
HIST_CTE = (
    "hist AS (SELECT headcode, rsid, stationName_from AS station_of_arrival, "
    f"{sq.dow_sunday0('leg_departure_dt')} AS day_of_week_bucket, {sq.time_bucket(_H)} AS time_of_day_bucket, "
    "COALESCE(AVG(vehicle_pax_on_arrival_std_at_from), 0) AS avg_vehicle_pax_on_arrival_std, "
    "COALESCE(AVG(vehicle_pax_on_arrival_first_at_from), 0) AS avg_vehicle_pax_on_arrival_first, "
    "COALESCE(AVG(totalUnitPassenger_at_leg_departure), 0) AS avg_total_unit_pax_on_arrival, "
    "COALESCE(AVG(onUnitPassenger_at_from_station), 0) AS avg_unit_boarders_at_station, "
    "COALESCE(AVG(offUnitPassenger_at_from_station), 0) AS avg_unit_alighters_at_station, "
    "COUNT(*) AS observations FROM legs WHERE headcode IS NOT NULL AND rsid IS NOT NULL AND stationName_from IS NOT NULL "
    "GROUP BY ALL HAVING COUNT(*) >= 3)")
COACH_CTE = ("coach AS (SELECT coach_type, COALESCE(AVG(vehicle_capacity), 0) AS avg_capacity, COUNT(*) AS frequency "
             "FROM legs WHERE coach_type IS NOT NULL GROUP BY coach_type)")
ALL_CTES = [sq.LEGS_CTE, *STATION_CTES, ROUTES_CTE, HIST_CTE, COACH_CTE]
_META = (f"SELECT '{lk.SOURCE_DATASET}' AS source_dataset, "
         "(SELECT COUNT(*) FROM legs) AS total_source_records_in_legs, "
         "(SELECT COUNT(*) FROM stations) AS stations_count, (SELECT COUNT(*) FROM routes) AS service_patterns_count, "
         "(SELECT COUNT(*) FROM hist) AS historical_patterns_count, (SELECT COUNT(*) FROM coach) AS coach_types_count, "
         f"'{lk.PURPOSE}' AS purpose")


def _validation() -> str:
    s = SAMPLE_STATION
    parts = ["SELECT 'tables_present' AS \"check\", TRUE AS passed, '' AS value"]
    for t, src in (("stations", "stations"), ("service_routes_summary_mvp", "routes"),
                   ("historical_averages", "hist"), ("coach_info", "coach"), ("metadata", "meta")):
        ok = "COUNT(*) > 0" if t == "stations" else "TRUE"
        parts.append(f"SELECT 'rows:{t}', {ok}, CAST(COUNT(*) AS VARCHAR) FROM {src}")
    parts.append(
        "SELECT 'station_coordinates', v IS NOT NULL, COALESCE(v, '') FROM (SELECT "
        "arg_min(CAST(latitude AS VARCHAR) || ',' || CAST(longitude AS VARCHAR), (latitude, longitude)) AS v "
        f"FROM stations WHERE station_name = '{s}')")
    parts.append(
        "SELECT 'code_round_trip', code IS NOT NULL AND name_back IS NOT NULL, "
        "COALESCE(code || '->' || name_back, '') FROM (SELECT c.code, (SELECT min(station_name) FROM stations "
        f"WHERE tiploc = c.code) AS name_back FROM (SELECT min(tiploc) AS code FROM stations WHERE station_name = '{s}' "
        "AND tiploc IS NOT NULL) c)")
    return sq.with_ctes(*ALL_CTES, f"meta AS ({_META})", body="\nUNION ALL\n".join(parts))


ORACLES = {
    "lookup_written": sq.with_ctes(*ALL_CTES, body=(
        "SELECT 'stations' AS table_name, COUNT(*) AS rows FROM stations UNION ALL "
        "SELECT 'service_routes_summary_mvp', COUNT(*) FROM routes UNION ALL SELECT 'historical_averages', COUNT(*) FROM hist "
        "UNION ALL SELECT 'coach_info', COUNT(*) FROM coach UNION ALL SELECT 'metadata', 1")),
    "lookup_codes_dedup": sq.with_ctes(*CODE_CTES, body=(
        "SELECT tiploc, nd AS normalized_desc_name, nt AS normalized_tps_desc_name, od AS tiploc_orig_desc, "
        "ot AS tiploc_orig_tps_desc, crs, pn AS primary_name FROM c2")),
    "lookup_station_locations": sq.with_ctes(sq.LEGS_CTE, *STATION_CTES, body="SELECT * FROM sl"),
    "lookup_stations_consolidated": sq.with_ctes(sq.LEGS_CTE, *STATION_CTES, body="SELECT * FROM sc"),
    "lookup_stations": sq.with_ctes(sq.LEGS_CTE, *STATION_CTES, body="SELECT * FROM stations"),
    "lookup_match_report": sq.with_ctes(sq.LEGS_CTE, *STATION_CTES, body=(
        "SELECT COUNT(*) AS stations, COUNT(tiploc) AS matched, COUNT(*) FILTER (WHERE tiploc IS NULL) AS unmatched, "
        "COUNT(*) FILTER (WHERE match_source = 'primary') AS matched_primary, "
        "COUNT(*) FILTER (WHERE match_source = 'description') AS matched_description, "
        "COUNT(*) FILTER (WHERE match_source = 'tps') AS matched_tps FROM stations")),
    "lookup_service_routes": sq.with_ctes(sq.LEGS_CTE, ROUTES_CTE, body="SELECT * FROM routes"),
    "lookup_historical_averages": sq.with_ctes(sq.LEGS_CTE, HIST_CTE, body=(
        "SELECT headcode, rsid, station_of_arrival, day_of_week_bucket, time_of_day_bucket, "
        "round(avg_vehicle_pax_on_arrival_std, 6) AS avg_vehicle_pax_on_arrival_std, "
        "round(avg_vehicle_pax_on_arrival_first, 6) AS avg_vehicle_pax_on_arrival_first, "
        "round(avg_total_unit_pax_on_arrival, 6) AS avg_total_unit_pax_on_arrival, "
        "round(avg_unit_boarders_at_station, 6) AS avg_unit_boarders_at_station, "
        "round(avg_unit_alighters_at_station, 6) AS avg_unit_alighters_at_station, observations FROM hist")),
    "lookup_coach_info": sq.with_ctes(sq.LEGS_CTE, COACH_CTE, body=(
        "SELECT coach_type, round(avg_capacity, 6) AS avg_capacity, frequency FROM coach")),
    "lookup_metadata": sq.with_ctes(*ALL_CTES, body=_META),
    "lookup_validation": _validation(),
}
