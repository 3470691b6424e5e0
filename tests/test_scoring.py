"""Batch scoring: datetime parsing, four-tier service match, defaults,
class pick, and the match against a brute-force reference."""

import random

from pyspark.sql import functions as F

from coachload.operators import features as fe, lookups as lk, model as md, scoring as sc, target as tg
from coachload.sources import requests as rq, tables
from tests.conftest import SF001

ROUTE_SCHEMA = ("headcode string, rsid string, stationName_from string, stationName_to string, "
                "hour int, day_of_week int, frequency long")
KEY_SCHEMA = "from_station string, to_station string, req_hour int, req_dow int"


def test_parse_datetime(spark):
    df = spark.createDataFrame([(0, "2024-01-15T08:30:00Z"), (1, "2024-01-15T08:30:00+05:00"),
                                (2, "2024-01-15"), (3, "2024"), (4, "15/01/2024 08:30"),
                                (5, "2024-01-15 08:30:00.250")], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(F.hour(sc.parse_datetime(F.col("s")))).collect()]
    assert got == [8, 8, 0, None, None, 8]


def test_match_tiers(spark):
    routes = spark.createDataFrame([
        ("H1", "R1", "A", "B", 8, 1, 5),     # A->B exact hour/day
        ("H2", "R1", "A", "B", 8, 1, 9),     # more frequent: wins tier 1
        ("H3", "R1", "C", "D", 10, 2, 1),    # C->D only at 10 (tier 2 from 8 or 12)
        ("H4", "R2", "C", "D", 6, 2, 7),     # 6 is 2 from 8 as well: frequency decides
        ("H5", "R1", "E", "F", 8, 3, 2),     # E: only to F
        ("H6", "R1", "G", "H", 15, 4, 2),    # G: only at 15
    ], ROUTE_SCHEMA)
    keys = spark.createDataFrame([
        ("A", "B", 8, 1), ("C", "D", 8, 2), ("E", "X", 8, 3), ("G", "X", 9, 4), ("Z", "B", 8, 1),
    ], KEY_SCHEMA)
    got = {(r["from_station"], r["to_station"]): (r["headcode"], r["match_tier"])
           for r in sc.match_service(keys, routes).collect()}
    assert got == {("A", "B"): ("H2", 1), ("C", "D"): ("H4", 2), ("E", "X"): ("H5", 3),
                   ("G", "X"): ("H6", 4), ("Z", "B"): (None, None)}


def test_arrival_defaults(spark):
    hist = spark.createDataFrame([("H1", "R1", "A", 1, "morning_peak", None, 2.0, 3.0, 4.0, 5.0, 3)],
                                 "headcode string, rsid string, station_of_arrival string, day_of_week_bucket int, "
                                 "time_of_day_bucket string, avg_vehicle_pax_on_arrival_std double, "
                                 "avg_vehicle_pax_on_arrival_first double, avg_total_unit_pax_on_arrival double, "
                                 "avg_unit_boarders_at_station double, avg_unit_alighters_at_station double, "
                                 "observations long")
    rows = spark.createDataFrame([("H1", "R1", "A", 8, 1), ("H1", "R1", "A", 13, 1)],
                                 "headcode string, rsid string, from_station string, req_hour int, req_dow int")
    got = {r["req_hour"]: tuple(r[c] for c in sc.HIST_DEFAULTS) for r in sc.arrival_state(rows, hist).collect()}
    assert got[8] == (0.0, 2.0, 3.0, 4.0, 5.0)       # found: NULL -> 0
    assert got[13] == (50.0, 10.0, 60.0, 15.0, 10.0)  # not found: defaults


def test_pick_class_first_max(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "probability array<double>")
    got = [(r["comfort_tier"], r["numeric_score"]) for r in sc.pick_class(df).collect()]
    assert got == [("Busy", 1), ("Quiet", 3)]


def _brute_force(keys, routes):
    out = {}
    for k in keys:
        f, t, h, d = k
        cands = [r for r in routes if r[2] == f]
        tiers = [
            [r for r in cands if r[3] == t and r[4] == h and r[5] == d],
            [r for r in cands if r[3] == t],
            [r for r in cands if r[4] == h and r[5] == d],
            cands,
        ]
        best = None
        for i, rs in enumerate(tiers, start=1):
            if rs:
                near = i in (2, 4)
                rs = sorted(rs, key=lambda r: (abs(r[4] - h) if near else 0, -r[6], r[0], r[1], r[3],
                                               r[5], r[4]))
                best = (rs[0][0], rs[0][1], rs[0][3], rs[0][6], i)
                break
        out[k] = best
    return out


def test_match_equals_brute_force(spark):
    legs = tables.legs(spark, SF001)
    routes = lk.service_routes(legs)
    rrows = [tuple(r) for r in routes.collect()]
    stations = sorted({r[2] for r in rrows} | {r[3] for r in rrows})
    rnd = random.Random(7)
    keys = list({(rnd.choice(stations), rnd.choice(stations), rnd.randrange(-5, 29), rnd.randrange(0, 7))
                 for _ in range(400)})
    kdf = spark.createDataFrame(keys, KEY_SCHEMA)
    got = {(r[0], r[1], r[2], r[3]): (None if r["match_tier"] is None else
                                      (r["headcode"], r["rsid"], r["next_stop"], r["frequency"], r["match_tier"]))
           for r in sc.match_service(kdf, routes).collect()}
    assert got == _brute_force(keys, rrows)


def test_parse_iso_forms(spark):
    forms = ["20240115T083000", "2024-01-15T08:30:00.123456789", "20240115T0830Z", "2024-01-15T08:30:00,5", "2024-01-15T08",
             "2024-01-1508:30", "2024-0115T08:30", "2024-13-01", "2024-01-15T08:30:00+5", ""]
    df = spark.createDataFrame(list(enumerate(forms)), "i int, s string")
    got = [str(r[0]) for r in df.orderBy("i").select(sc.parse_datetime(F.col("s"))).collect()]
    assert got == ["2024-01-15 08:30:00", "2024-01-15 08:30:00.123456", "2024-01-15 08:30:00", "2024-01-15 08:30:00.500000",
                   "2024-01-15 08:00:00", *["None"] * 5]


def _fixture(spark):
    legs = tables.legs(spark, SF001)
    codes = tables.clean_codes(tables.tiplocs(spark, SF001))
    lookups = lk.build_lookups(legs, codes)
    lookups["stations"] = rq.fixture_stations(lookups["stations"])
    return legs, lookups, rq.fixture_requests(legs, lookups["stations"])


def test_error_rows(spark):
    _, lookups, reqs = _fixture(spark)
    rows = sc.resolve_codes(sc.explode_requests(reqs), lookups["stations"])
    st = {r["request_id"]: (r["status"], r["error"]) for r in
          rows.where(F.col("status").isNotNull()).select("request_id", "status", "error").distinct().collect()}
    assert st == {
        "invalid-datetime": (400, "Invalid datetime format: 15/01/2024 08:30"),
        "unknown-code": (404, "Station not found for TIPLOC: NOSUCHCODE"),
        "empty-list-unknown": (404, "Station not found for TIPLOC: NOSUCHCODE"),
        "missing-field": (422, "Field required: to_tiploc"),
        "missing-list": (422, "Field required: departure_datetimes"),
        "null-item": (422, "Input should be a valid string: departure_datetimes")}


def test_nested_keeps_requests_apart(spark):
    legs, lookups, reqs = _fixture(spark)
    model = md.ThresholdModel(tg.thresholds(tg.occupancy_pct(legs)))
    labels = fe.fit_labels(fe.add_time_features(legs))
    special = reqs.where(~F.col("request_id").contains(">"))
    flat = sc.score(special, lookups, model, labels, fe.selected_features())
    assert {r["fallback_used"] for r in flat.where("status = 200 and pos is not null").collect()} == {"True", "False"}
    got = {}
    for r in sc.nest(flat).collect():
        got.setdefault(r["request_id"], []).append((r["status"], None if r["predictions"] is None else len(r["predictions"])))
    assert sorted(got["twice"]) == [(200, 1), (200, 2)]
    assert got["empty-list"] == [(200, 0)] and got["no-service"] == [(404, None)] and got["null-item"] == [(422, None)]
    assert got["basic-iso"] == [(200, 3)] and got["same-station"] == [(200, 2)] and len(got) == len({x[0] for x in rq.SPECIAL})
    text = sc.score(special, lookups, model, labels, fe.selected_features())._jdf.queryExecution().optimizedPlan().toString()
    assert "pivot" not in text.lower()
