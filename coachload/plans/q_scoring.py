"""Registered batch-scoring queries (P1-P12, S6) and their SQL oracles.

The model in the oracle-checked queries is the rule-based ThresholdModel
(thresholds = training quantiles), so the SQL side can reproduce every
probability; the trained boosting model is scored in ``q_model``.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import functions as F

from coachload.operators import features as fe, lookups as lk, model as md, scoring as sc
from coachload.operators import target as tg
from coachload.plans import sqlparts as sq
from coachload.plans.q_features import _DICT, _haversine, _planar
from coachload.plans.q_lookups import HIST_CTE, ROUTES_CTE, STATION_CTES
from coachload.session import materialize, scratch_path
from coachload.sources import requests as rq, tables

MATCH_COLS = ["headcode", "rsid", "next_stop", "frequency", "match_tier"]
SERVE_FEATURES = [f for f in fe.selected_features()]
SERVE_COLS = ["request_id", "pos", "coach_type"] + SERVE_FEATURES


# Columns of the legs that the scoring inputs are built from.
STATION_LEGS = ["stationName_from", "stationLocation_from", "stationName_to", "stationLocation_to"]
SCORING_LEGS = [*STATION_LEGS, "headcode", "rsid", "coach_type", "leg_departure_dt",
                "relevant_passengers_on_leg_departure", "vehicle_capacity",
                *[src for src, _ in lk.HIST_AVERAGES]]


class Ctx:
    """Inputs shared by the scoring queries.

    The legs are pruned to ``columns``.  ``stored`` says that several inputs
    read them: they are then written once, as a deployment reads stored legs;
    otherwise they are read straight from the tables.  The lookup tables and
    the label dictionary, which are read repeatedly, are small and written
    once, as a deployment reads the written lookup set (S3).
    """

    def __init__(self, spark, sf_dir, columns=None, stored=True):
        self.spark, self.sf_dir = spark, sf_dir
        self.columns, self.stored = columns or SCORING_LEGS, stored

    @cached_property
    def legs(self):
        if self.stored:
            return tables.stored_legs(self.spark, self.sf_dir, self.columns)
        return tables.legs(self.spark, self.sf_dir).select(*self.columns)

    @cached_property
    def plain_stations(self):
        codes = tables.clean_codes(tables.tiplocs(self.spark, self.sf_dir))
        return lk.build_stations(self.legs, codes)

    @cached_property
    def stations(self):
        return materialize(rq.fixture_stations(self.plain_stations), "stations")

    @cached_property
    def routes(self):
        return lk.service_routes(self.legs)   # read once, by the match

    @cached_property
    def hist(self):
        return lk.historical_averages(self.legs)

    @cached_property
    def requests(self):
        return rq.fixture_requests(self.legs, self.stations)

    @cached_property
    def labels(self):
        return materialize(fe.fit_labels(fe.add_time_features(self.legs)), "labels")

    @cached_property
    def thresholds(self):
        return materialize(tg.thresholds(tg.occupancy_pct(self.legs)), "thresholds")

    def lookups(self):
        return {"stations": self.stations, "service_routes_summary_mvp": self.routes,
                "historical_averages": self.hist}


REQUEST_LEGS = STATION_LEGS
MATCH_LEGS = ["stationName_from", "stationName_to", "headcode", "rsid", "leg_departure_dt", "next_station_departure_dt"]


def q_requests(spark, sf_dir):
    c = Ctx(spark, sf_dir, REQUEST_LEGS)
    return sc.explode_requests(c.requests).select(
        "request_id", "pos", "departure_datetime", "departure_ts", "status", "error")


def q_requests_read(spark, sf_dir):
    """The fixture's requests and some broken lines as JSON lines, read back."""
    c = Ctx(spark, sf_dir, REQUEST_LEGS)
    path = f"{scratch_path(spark, 'requests')}-{uuid.uuid4().hex}"
    broken = spark.createDataFrame([(x,) for x in rq.BROKEN_LINES], "value string")
    c.requests.select(F.to_json(F.struct(*rq.REQUEST_SCHEMA.names), {"ignoreNullFields": "false"}).alias("value")).unionByName(broken).write.text(path)
    rows = sc.explode_requests(rq.read_requests(spark, path))
    return rows.select("request_id", "pos", "departure_datetime", "departure_ts", "status", "error")


def q_resolved(spark, sf_dir):
    c = Ctx(spark, sf_dir, REQUEST_LEGS)
    r = sc.resolve_codes(sc.explode_requests(c.requests), c.stations)
    return r.select("request_id", "pos", "from_station", "to_station", "from_lat", "from_lon",
                    "to_lat", "to_lon", "status", "error")


def q_match_probe(spark, sf_dir):
    c = Ctx(spark, sf_dir, MATCH_LEGS)
    return sc.match_service(rq.probe_keys(c.legs), c.routes)


def q_match_requests(spark, sf_dir):
    c = Ctx(spark, sf_dir, [*STATION_LEGS, "headcode", "rsid", "leg_departure_dt"])
    rows = sc.request_time_keys(sc.resolve_codes(sc.explode_requests(c.requests), c.stations))
    return sc.match_service(rows.where(F.col("status").isNull() & F.col("pos").isNotNull()), c.routes)


def q_arrival(spark, sf_dir):
    c = Ctx(spark, sf_dir, [*MATCH_LEGS, *[src for src, _ in lk.HIST_AVERAGES]])
    m = sc.match_service(rq.probe_keys(c.legs), c.routes).where(F.col("match_tier").isNotNull())
    a = sc.arrival_state(m, c.hist)
    return a.select(*sc.REQUEST_KEY, *[F.round(k, 6).alias(k) for k in sc.HIST_DEFAULTS])


def _serving_rows(c: Ctx, skew=None):
    rows = sc.request_time_keys(sc.resolve_codes(sc.explode_requests(c.requests), c.stations))
    ok = rows.where(F.col("status").isNull() & F.col("pos").isNotNull())
    ok = ok.join(sc.match_service(ok, c.routes), sc.REQUEST_KEY, "left").where(
        F.col("match_tier").isNotNull())
    ok = sc.arrival_state(ok, c.hist)
    feats = sc.serving_features(sc.fan_out(ok), skew)
    return sc.apply_serving_labels(feats, c.labels)


def q_features(spark, sf_dir):
    f = _serving_rows(Ctx(spark, sf_dir))
    return f.select(*[F.round(x, 6).alias(x) if x == "route_distance_km" else x for x in SERVE_COLS])


def _predictions(skew=None, dow="sunday0"):
    def run(spark, sf_dir):
        c = Ctx(spark, sf_dir)
        model = md.ThresholdModel(c.thresholds)
        return sc.score(c.requests, c.lookups(), model, c.labels, SERVE_FEATURES, dow=dow, skew=skew)
    return run


def q_predictions(spark, sf_dir):
    return _predictions()(spark, sf_dir).drop(sc.ROW_ID)


def q_predictions_reference(spark, sf_dir):
    return _predictions(skew="reference", dow="reference")(spark, sf_dir).drop(sc.ROW_ID)


def _as_json(nested):
    return nested.select("request_id", "status", "error",
                         F.to_json("predictions", {"ignoreNullFields": "false"}).alias("predictions"))


def q_nested(spark, sf_dir):
    return _as_json(sc.nest(_predictions()(spark, sf_dir)))


def q_written(spark, sf_dir):
    """The nested response written and read back."""
    path = f"{scratch_path(spark, 'predictions')}-{uuid.uuid4().hex}"
    sc.write_predictions(_predictions()(spark, sf_dir), path, "parquet")
    return _as_json(sc.read_predictions(spark, path))


def q_list_stations(spark, sf_dir):
    return sc.list_stations(Ctx(spark, sf_dir, STATION_LEGS, stored=False).plain_stations)


def q_list_codes(spark, sf_dir):
    return sc.list_codes(Ctx(spark, sf_dir, STATION_LEGS, stored=False).plain_stations)


QUERIES = {
    "scoring_requests": q_requests,
    "scoring_resolved": q_resolved,
    "scoring_requests_read": q_requests_read,
    "scoring_service_match": q_match_probe,
    "scoring_service_match_requests": q_match_requests,
    "scoring_arrival_state": q_arrival,
    "scoring_features": q_features,
    "scoring_predictions": q_predictions,
    "scoring_predictions_reference_mode": q_predictions_reference,
    "scoring_nested": q_nested,
    "scoring_written": q_written,
    "scoring_list_stations": q_list_stations,
    "scoring_list_codes": q_list_codes,
}

# --- oracle texts -----------------------------------------------------------
ISO = sc.ISO_DATETIME


def _list(times):
    if times is None:
        return "CAST(NULL AS VARCHAR[])"
    return "CAST([" + ", ".join("NULL" if d is None else f"'{d}'" for d in times) + "] AS VARCHAR[])"


def _code(c):
    return {"f": "from_tiploc", "t": "to_tiploc", None: "CAST(NULL AS VARCHAR)"}.get(c, f"'{c}'")


DTS = _list(rq.FIXTURE_DATETIMES)


def _g(i):
    return f"regexp_extract(departure_datetime, '{ISO}', {i})"


def _two(i):
    return f"CASE WHEN {_g(i)} = '' THEN '00' ELSE {_g(i)} END"


WALL = (f"{_g(1)} || '-' || {_g(2)} || {_g(3)} || '-' || {_g(4)} || ' ' || {_two(5)} || ':' || {_two(6)} || ':' || "
        f"{_two(7)} || '.' || rpad(left({_g(8)}, 6), 6, '0')")
_OFF = f"replace({_g(9)}, ':', '')"
ISO_TEXT = (
    "strftime(departure_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', departure_ts) % 1000000 <> 0 "
    "THEN strftime(departure_ts, '.%f') ELSE '' END || "
    f"CASE WHEN {_OFF} = '' THEN '' WHEN {_OFF} IN ('Z', '-00', '-0000') THEN '+00:00' WHEN length({_OFF}) = 3 THEN {_OFF} || ':00' "
    f"ELSE left({_OFF}, 3) || ':' || substr({_OFF}, 4, 2) END")


def D(x):
    return f"CAST({x} AS DOUBLE)"


REQUEST_CTES = [
    "cbn AS (SELECT station_name, min(tiploc) AS code FROM stations WHERE tiploc IS NOT NULL GROUP BY station_name)",
    "pairs AS (SELECT DISTINCT stationName_from AS f, stationName_to AS t FROM legs)",
    f"valid AS (SELECT cf.code || '>' || ct.code AS rid, cf.code || '>' || ct.code AS request_id, cf.code AS from_tiploc, "
    f"ct.code AS to_tiploc, {DTS} AS departure_datetimes FROM pairs JOIN cbn cf ON cf.station_name = pairs.f "
    "JOIN cbn ct ON ct.station_name = pairs.t)",
    "fp AS (SELECT from_tiploc, to_tiploc FROM valid ORDER BY from_tiploc, to_tiploc LIMIT 1)",
    "requests AS (SELECT * FROM valid " + " ".join(
        f"UNION ALL SELECT '{row}', '{rid}', {_code(f)}, {_code(t)}, {_list(times)} FROM fp" for rid, row, f, t, times in rq.SPECIAL) + ")",
    "ex0 AS (SELECT rid, request_id, from_tiploc, to_tiploc, departure_datetimes IS NULL AS no_list, "
    "CAST(generate_subscripts(departure_datetimes, 1) - 1 AS INTEGER) AS pos, "
    "unnest(departure_datetimes) AS departure_datetime FROM requests UNION ALL "
    "SELECT rid, request_id, from_tiploc, to_tiploc, departure_datetimes IS NULL, NULL, NULL FROM requests "
    "WHERE COALESCE(len(departure_datetimes), 0) = 0)",
    f"ex1 AS (SELECT ex0.*, CASE WHEN regexp_full_match(departure_datetime, '{ISO}') THEN "
    f"TRY_CAST({WALL} AS TIMESTAMP) END AS departure_ts FROM ex0)",
    "bad AS (SELECT rid, arg_min(departure_datetime, pos) FILTER (departure_datetime IS NOT NULL AND departure_ts IS NULL) AS first_bad, "
    "bool_or(pos IS NOT NULL AND departure_datetime IS NULL) AS null_item FROM ex1 GROUP BY rid)",
    "ex AS (SELECT ex1.*, CASE WHEN from_tiploc IS NULL OR to_tiploc IS NULL OR no_list OR null_item THEN 422 "
    "WHEN bad.first_bad IS NOT NULL THEN 400 END AS status0, "
    "CASE WHEN from_tiploc IS NULL THEN 'Field required: from_tiploc' WHEN to_tiploc IS NULL THEN "
    "'Field required: to_tiploc' WHEN no_list THEN 'Field required: departure_datetimes' "
    f"WHEN null_item THEN '{sc.BAD_ITEM}' WHEN bad.first_bad IS NOT NULL THEN 'Invalid datetime format: ' || bad.first_bad "
    "END AS error0 FROM ex1 LEFT JOIN bad USING (rid))",
    f"stations_x AS (SELECT tiploc, station_name, latitude, longitude FROM stations UNION ALL "
    f"SELECT '{rq.NO_SERVICE_CODE}', '{rq.NO_SERVICE_STATION}', 51.0, -1.0)",
    "dim AS (SELECT tiploc, min(station_name) AS station_name, arg_min(latitude, station_name) AS latitude, "
    "arg_min(longitude, station_name) AS longitude FROM stations_x WHERE tiploc IS NOT NULL GROUP BY tiploc)",
    "rs AS (SELECT ex.*, f.station_name AS from_station, f.latitude AS from_lat, f.longitude AS from_lon, "
    "t.station_name AS to_station, t.latitude AS to_lat, t.longitude AS to_lon, "
    "CASE WHEN status0 IS NOT NULL THEN status0 WHEN f.station_name IS NULL OR t.station_name IS NULL THEN 404 END AS status, "
    "CASE WHEN status0 IS NOT NULL THEN error0 WHEN f.station_name IS NULL THEN 'Station not found for TIPLOC: ' || from_tiploc "
    "WHEN t.station_name IS NULL THEN 'Station not found for TIPLOC: ' || to_tiploc END AS error "
    "FROM ex LEFT JOIN dim f ON f.tiploc = ex.from_tiploc LEFT JOIN dim t ON t.tiploc = ex.to_tiploc)",
]


def _time_keys(dow: str) -> str:
    d = sq.dow_sunday0("departure_ts") if dow == "sunday0" else sq.dow_monday0("departure_ts")
    return f"rk AS (SELECT rs.*, {sq.hour('departure_ts')} AS req_hour, {d} AS req_dow FROM rs)"


_ORDER = "r.frequency DESC, r.headcode, r.rsid, r.stationName_to, r.day_of_week, r.hour"
_KEYP = "PARTITION BY k.from_station, k.to_station, k.req_hour, k.req_dow"
_KEYJ = ("x.from_station = k.from_station AND x.to_station = k.to_station AND x.req_hour = k.req_hour "
         "AND x.req_dow = k.req_dow")


def match_ctes(keys_sql: str) -> list[str]:
    """The four-query cascade, one tier after the other.  Tiers 2 and 4 first
    keep the best route of each hour, which is all they can pick from."""
    sel = ("SELECT k.from_station, k.to_station, k.req_hour, k.req_dow, r.headcode, r.rsid, "
           "r.stationName_to AS next_stop, r.frequency")
    best = "ORDER BY r.frequency DESC, r.headcode, r.rsid, r.stationName_to, r.day_of_week"
    return [
        f"keys AS ({keys_sql})",
        f"r2 AS (SELECT * FROM routes r QUALIFY ROW_NUMBER() OVER (PARTITION BY stationName_from, stationName_to, hour {best}) = 1)",
        f"r3 AS (SELECT * FROM routes r QUALIFY ROW_NUMBER() OVER (PARTITION BY stationName_from, hour, day_of_week {best}) = 1)",
        f"r4 AS (SELECT * FROM routes r QUALIFY ROW_NUMBER() OVER (PARTITION BY stationName_from, hour {best}) = 1)",
        f"t1 AS ({sel}, 1 AS tier, ROW_NUMBER() OVER ({_KEYP} ORDER BY {_ORDER}) AS rn FROM keys k JOIN routes r "
        "ON r.stationName_from = k.from_station AND r.stationName_to = k.to_station AND r.hour = k.req_hour "
        "AND r.day_of_week = k.req_dow)",
        f"k2 AS (SELECT * FROM keys k WHERE NOT EXISTS (SELECT 1 FROM t1 x WHERE {_KEYJ}))",
        f"t2 AS ({sel}, 2 AS tier, ROW_NUMBER() OVER ({_KEYP} ORDER BY abs(r.hour - k.req_hour), {_ORDER}) AS rn "
        "FROM k2 k JOIN r2 r ON r.stationName_from = k.from_station AND r.stationName_to = k.to_station)",
        f"k3 AS (SELECT * FROM k2 k WHERE NOT EXISTS (SELECT 1 FROM t2 x WHERE {_KEYJ}))",
        f"t3 AS ({sel}, 3 AS tier, 1 AS rn FROM k3 k JOIN r3 r "
        "ON r.stationName_from = k.from_station AND r.hour = k.req_hour AND r.day_of_week = k.req_dow)",
        f"k4 AS (SELECT * FROM k3 k WHERE NOT EXISTS (SELECT 1 FROM t3 x WHERE {_KEYJ}))",
        f"t4 AS ({sel}, 4 AS tier, ROW_NUMBER() OVER ({_KEYP} ORDER BY abs(r.hour - k.req_hour), {_ORDER}) AS rn "
        "FROM k4 k JOIN r4 r ON r.stationName_from = k.from_station)",
        "tiers AS (SELECT * FROM t1 WHERE rn = 1 UNION ALL SELECT * FROM t2 WHERE rn = 1 "
        "UNION ALL SELECT * FROM t3 WHERE rn = 1 UNION ALL SELECT * FROM t4 WHERE rn = 1)",
        "matched AS (SELECT k.*, x.headcode, x.rsid, x.next_stop, x.frequency, CAST(x.tier AS INTEGER) AS match_tier "
        f"FROM keys k LEFT JOIN tiers x ON {_KEYJ})",
    ]


PROBE_KEYS = (
    f"SELECT DISTINCT * FROM (SELECT stationName_from AS from_station, stationName_to AS to_station, "
    f"{sq.hour('next_station_departure_dt')} AS req_hour, {sq.dow_sunday0('next_station_departure_dt')} AS req_dow FROM legs "
    f"UNION ALL SELECT stationName_from, stationName_from, {sq.hour('leg_departure_dt')} - 5, "
    f"{sq.dow_sunday0('leg_departure_dt')} FROM legs) u WHERE from_station IS NOT NULL")

_HISTJ = ("LEFT JOIN hist h ON h.headcode = m.headcode AND h.rsid = m.rsid AND h.station_of_arrival = m.from_station "
          f"AND h.day_of_week_bucket = m.req_dow AND h.time_of_day_bucket = {sq.time_bucket('m.req_hour')}")
_AVG = [(c, v) for c, v in sc.HIST_DEFAULTS.items()]


def _arrival_cols(prefix="h.", hit="h.headcode IS NOT NULL"):
    return ", ".join(f"CASE WHEN {hit} THEN COALESCE({D(prefix + c)}, 0.0) ELSE {D(v)} END AS {c}"
                     for c, v in _AVG)


def _base(dow="sunday0"):
    return [sq.LEGS_CTE, *STATION_CTES, ROUTES_CTE, HIST_CTE, *REQUEST_CTES, _time_keys(dow)]


def _serve_ctes(skew=None, dow="sunday0") -> list[str]:
    ref = skew == "reference"
    h = sq.hour("departure_ts")
    dwm = sq.dow_monday0("departure_ts")
    period = sq.period_serve(h) if ref else sq.period_train(h)
    dist = (_planar if ref else _haversine)("from_lat", "from_lon", "to_lat", "to_lon")
    if ref:
        def has(c, words):
            return "CAST(CASE WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words) + " THEN 1 ELSE 0 END AS INTEGER)"
        lon = lambda c: has(c, fe.LONDON_SUBSTRINGS)
        maj = lambda c: has(c, fe.MAJOR_CITY_SUBSTRINGS)
    else:
        def one_of(c, names):
            return f"CAST(CASE WHEN {c} IN (" + ", ".join(f"'{n}'" for n in names) + ") THEN 1 ELSE 0 END AS INTEGER)"
        lon = lambda c: one_of(c, fe.LONDON_STATIONS)
        maj = lambda c: one_of(c, fe.MAJOR_CITY_STATIONS)
    std = "coach_type = 'Standard'"
    fst = "coach_type = 'First Class'"
    cap = f"CASE WHEN {std} THEN {D(89.0)} WHEN {fst} THEN {D(60.0)} ELSE {D(115.0)} END"
    den_std = f"CASE WHEN {std} THEN {D(89.0)} ELSE {D(60.0)} END"
    den_first = f"CASE WHEN {fst} THEN {D(60.0)} ELSE {D(89.0)} END"
    den_tot = f"CASE WHEN {std} THEN {D(89.0)} ELSE {D(115.0)} END"
    a_std, a_fst = "avg_vehicle_pax_on_arrival_std", "avg_vehicle_pax_on_arrival_first"
    board, alight = "avg_unit_boarders_at_station", "avg_unit_alighters_at_station"
    enc = lambda col, val: (f"CAST(COALESCE((SELECT code FROM dict WHERE \"column\" = '{col}' "  # noqa: E731
                            f"AND value = {val}), 0) AS INTEGER) AS {col}_encoded")
    return [
        *_base(dow), sq.TIME_FEATURES_CTE, _DICT,
        *match_ctes("SELECT DISTINCT from_station, to_station, req_hour, req_dow FROM rk WHERE status IS NULL AND pos IS NOT NULL"),
        "ok0 AS (SELECT rk.*, m.headcode, m.rsid, m.next_stop, m.frequency, m.match_tier FROM rk JOIN matched m "
        "USING (from_station, to_station, req_hour, req_dow) WHERE rk.status IS NULL AND rk.pos IS NOT NULL)",
        "nos AS (SELECT rid, max(CASE WHEN match_tier IS NULL THEN 1 ELSE 0 END) AS no_service, "
        "min(CASE WHEN match_tier IS NULL THEN from_station END) AS ns_from FROM ok0 GROUP BY rid)",
        f"ar AS (SELECT m.*, {_arrival_cols()} FROM ok0 m {_HISTJ} "
        "WHERE m.rid IN (SELECT rid FROM nos WHERE no_service = 0))",
        "fo AS (SELECT ar.*, c.coach_type FROM ar CROSS JOIN (VALUES ('Standard'), ('First Class')) c(coach_type))",
        f"sf AS (SELECT rid, request_id, pos, coach_type, {h} AS hour_of_day, {dwm} AS day_of_week, "
        "CAST(EXTRACT(month FROM departure_ts) AS INTEGER) AS month, "
        f"CAST(CASE WHEN {dwm} >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend, "
        f"CAST(CASE WHEN {h} BETWEEN 7 AND 9 OR {h} BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS INTEGER) AS is_peak_hour, "
        f"{period} AS time_period, from_lat, from_lon, to_lat, to_lon, {dist} AS route_distance_km, "
        f"{lon('from_station')} AS from_london, {lon('to_station')} AS to_london, "
        f"{maj('from_station')} AS from_major_city, {maj('to_station')} AS to_major_city, "
        f"{cap} AS vehicle_capacity, {a_std} AS vehicle_pax_on_arrival_std_at_from, "
        f"{a_fst} AS vehicle_pax_on_arrival_first_at_from, "
        "avg_total_unit_pax_on_arrival AS totalUnitPassenger_at_leg_departure, "
        f"{board} AS onUnitPassenger_at_from_station, {alight} AS offUnitPassenger_at_from_station, "
        f"{board} * 0.7 AS vehicle_pax_boarded_std_at_from, {board} * 0.3 AS vehicle_pax_boarded_first_at_from, "
        f"{alight} * 0.7 AS vehicle_pax_alighted_std_at_from, {alight} * 0.3 AS vehicle_pax_alighted_first_at_from, "
        f"{a_std} / {den_std} * 100.0 AS occupancy_percentage_std, "
        f"{a_fst} / {den_first} * 100.0 AS occupancy_percentage_first, "
        f"{a_std} + {a_fst} AS total_occupancy, ({a_std} + {a_fst}) / {den_tot} * 100.0 AS total_occupancy_percentage, "
        f"{board} / {den_tot} * 100.0 AS boarding_ratio, {alight} / {den_tot} * 100.0 AS alighting_ratio, "
        f"({a_std} + {a_fst}) / {den_tot} * 100.0 AS capacity_utilization, "
        f"{enc('coach_type', 'coach_type')}, {enc('stationName_from', 'from_station')}, "
        f"{enc('stationName_to', 'to_station')}, {enc('headcode', 'headcode')}, {enc('rsid', 'rsid')}, "
        f"{enc('time_period', period)} FROM fo)",
    ]


def _features_sql() -> str:
    cols = ", ".join("round(route_distance_km, 6) AS route_distance_km" if c == "route_distance_km" else c
                     for c in SERVE_COLS)
    return sq.with_ctes(*_serve_ctes(), body=f"SELECT {cols} FROM sf")


OCC_THR = [
    f"occt AS (SELECT {sq.pct('relevant_passengers_on_leg_departure', 'vehicle_capacity')} AS x FROM legs)",
    "thr AS (SELECT quantile_cont(x, 0.33) AS low, quantile_cont(x, 0.67) AS high FROM occt)",
]


def _predictions_sql(skew=None, dow="sunday0", nested=False) -> str:
    tier = ("CASE WHEN total_occupancy_percentage <= thr.low THEN 'Quiet' "
            "WHEN total_occupancy_percentage <= thr.high THEN 'Moderate' ELSE 'Busy' END")
    score = "CASE {t} WHEN 'Busy' THEN 1 WHEN 'Moderate' THEN 2 ELSE 3 END"
    ctes = [*_serve_ctes(skew, dow), *OCC_THR,
            f"pc AS (SELECT rid, pos, coach_type, {tier} AS tier FROM sf CROSS JOIN thr)",
            "wide AS (SELECT rid, pos, "
            "max(CASE WHEN coach_type = 'Standard' THEN tier END) AS standard_tier, "
            "max(CASE WHEN coach_type = 'First Class' THEN tier END) AS first_tier FROM pc GROUP BY rid, pos)",
            "good AS (SELECT a.rid, a.request_id, a.pos, a.from_tiploc, a.to_tiploc, a.from_station, a.to_station, "
            f"{ISO_TEXT} AS departure_datetime, a.headcode, a.rsid, a.next_stop, "
            "CASE WHEN a.match_tier = 4 THEN 'True' ELSE 'False' END AS fallback_used, "
            "CASE WHEN a.match_tier = 2 THEN 'True' ELSE 'False' END AS time_fallback, "
            "CASE WHEN a.match_tier = 3 THEN 'True' ELSE 'False' END AS route_fallback, "
            "200 AS status, CAST(NULL AS VARCHAR) AS error, "
            f"w.standard_tier, CAST(0.8 AS DOUBLE) AS standard_confidence, CAST({score.format(t='w.standard_tier')} AS INTEGER) AS standard_score, "
            f"w.first_tier, CAST(0.8 AS DOUBLE) AS first_confidence, CAST({score.format(t='w.first_tier')} AS INTEGER) AS first_score "
            "FROM ar a JOIN wide w USING (rid, pos))",
            "failed AS (SELECT rid, min(request_id) AS request_id, min(from_tiploc) AS from_tiploc, min(to_tiploc) AS to_tiploc, "
            "min(status) AS status, min(error) AS error FROM rk WHERE status IS NOT NULL GROUP BY rid "
            "UNION ALL SELECT rid, request_id, from_tiploc, to_tiploc, 200, NULL FROM rk WHERE status IS NULL AND pos IS NULL "
            "UNION ALL SELECT n.rid, min(o.request_id), min(o.from_tiploc), min(o.to_tiploc), 404, "
            "'No services found from ' || min(n.ns_from) FROM nos n JOIN ok0 o USING (rid) "
            "WHERE n.no_service = 1 GROUP BY n.rid)"]
    if nested:
        item = ("struct_pack(pos := pos, from_tiploc := from_tiploc, to_tiploc := to_tiploc, from_station := from_station, "
                "to_station := to_station, departure_datetime := departure_datetime, "
                "standard_class := struct_pack(comfort_tier := standard_tier, confidence := standard_confidence, numeric_score := standard_score), "
                "first_class := struct_pack(comfort_tier := first_tier, confidence := first_confidence, numeric_score := first_score), "
                "service_info := struct_pack(headcode := headcode, rsid := rsid, next_stop := next_stop, fallback_used := fallback_used, "
                "time_fallback := time_fallback, route_fallback := route_fallback))")
        return sq.with_ctes(*ctes, body=(
            f"SELECT min(request_id) AS request_id, 200 AS status, CAST(NULL AS VARCHAR) AS error, "
            f"CAST(to_json(list({item} ORDER BY pos)) AS VARCHAR) AS predictions FROM good GROUP BY rid "
            "UNION ALL SELECT request_id, status, error, CASE WHEN status = 200 THEN '[]' END FROM failed"))
    return sq.with_ctes(*ctes, body=(
        "SELECT request_id, pos, from_tiploc, to_tiploc, from_station, to_station, departure_datetime, headcode, "
        "rsid, next_stop, fallback_used, time_fallback, route_fallback, status, error, standard_tier, "
        "standard_confidence, standard_score, first_tier, first_confidence, first_score FROM good "
        "UNION ALL SELECT request_id, NULL, from_tiploc, to_tiploc, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, "
        "NULL, status, error, NULL, NULL, NULL, NULL, NULL, NULL FROM failed"))


ORACLES = {
    "scoring_requests": sq.with_ctes(*_base(), body=(
        "SELECT request_id, pos, departure_datetime, departure_ts, status0 AS status, error0 AS error FROM ex")),
    "scoring_resolved": sq.with_ctes(*_base(), body=(
        "SELECT request_id, pos, from_station, to_station, from_lat, from_lon, to_lat, to_lon, status, error FROM rs")),
    "scoring_requests_read": sq.with_ctes(*_base(), body=(
        "SELECT request_id, pos, departure_datetime, departure_ts, status0 AS status, error0 AS error FROM ex UNION ALL "
        f"SELECT CASE WHEN x LIKE '%text-for-list%' THEN 'text-for-list' ELSE sha256(x) END, NULL, NULL, NULL, 400, '{sc.BAD_REQUEST}' "
        "FROM (VALUES " + ", ".join(f"('{x}')" for x in rq.BROKEN_LINES) + ") v(x)")),
    "scoring_service_match": sq.with_ctes(*sq.stored(sq.LEGS_CTE, ROUTES_CTE, *match_ctes(PROBE_KEYS)),
                                          body="SELECT * FROM matched"),
    "scoring_service_match_requests": sq.with_ctes(
        *_base(), *match_ctes("SELECT DISTINCT from_station, to_station, req_hour, req_dow FROM rk WHERE status IS NULL AND pos IS NOT NULL"),
        body="SELECT * FROM matched"),
    "scoring_arrival_state": sq.with_ctes(
        *sq.stored(sq.LEGS_CTE, ROUTES_CTE, HIST_CTE, *match_ctes(PROBE_KEYS)),
        body=("SELECT m.from_station, m.to_station, m.req_hour, m.req_dow, "
              + ", ".join(f"round(CASE WHEN h.headcode IS NOT NULL THEN COALESCE({D('h.' + c)}, 0.0) "
                          f"ELSE {D(v)} END, 6) AS {c}" for c, v in _AVG)
              + f" FROM matched m {_HISTJ} WHERE m.match_tier IS NOT NULL")),
    "scoring_features": _features_sql(),
    "scoring_predictions": _predictions_sql(),
    "scoring_predictions_reference_mode": _predictions_sql("reference", "reference"),
    "scoring_nested": _predictions_sql(nested=True),
    "scoring_written": _predictions_sql(nested=True),
    "scoring_list_stations": sq.with_ctes(sq.LEGS_CTE, *STATION_CTES, body=(
        "SELECT tiploc, station_name FROM stations WHERE tiploc IS NOT NULL ORDER BY station_name, tiploc")),
    "scoring_list_codes": sq.with_ctes(sq.LEGS_CTE, *STATION_CTES, body=(
        "SELECT tiploc, station_name, tiploc_orig_desc, tiploc_orig_tps_desc FROM stations "
        "WHERE tiploc IS NOT NULL ORDER BY tiploc, station_name")),
}
