"""Batch scoring of (origin code, destination code, departure times)
requests (P1-P12), re-aimed from a one-request-at-a-time service.

Plan shape: requests -> validate (on the request's own array) -> explode ->
code lookup -> service match on the distinct (origin, destination, hour,
weekday) keys -> historical averages -> features, model and pick per class,
side by side in one row -> response rows.  Every request row has an id of its
own from the start, so requests that repeat a ``request_id`` stay apart.

Service match (P3) without a nearest-hour loop or a request x all-routes
join: the route table is reduced with ``min_by`` to the best route per
(from, to, hour, dow), and that table is rolled up to the other tiers' keys,
so every request key meets at most one candidate per tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coachload.functions import geo, time as tm
from coachload.operators import features as fe
from coachload.operators.joins import small_side
from coachload.sources.published import publish, read_published

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
CLASS_NAMES = ["Busy", "Moderate", "Quiet"]          # model output order
NUMERIC_SCORE = {"Busy": 1, "Moderate": 2, "Quiet": 3}
SERVICE_CLASSES = ["Standard", "First Class"]        # scored for every request
CAPACITY = {"Standard": 89.0, "First Class": 60.0, "other": 115.0}
BOARD_SPLIT = (0.7, 0.3)                             # standard, first share
HIST_DEFAULTS = {"avg_vehicle_pax_on_arrival_std": 50.0,
                 "avg_vehicle_pax_on_arrival_first": 10.0,
                 "avg_total_unit_pax_on_arrival": 60.0,
                 "avg_unit_boarders_at_station": 15.0,
                 "avg_unit_alighters_at_station": 10.0}
# ---------------------------------------------------------------------------

REQUEST_KEY = ["from_station", "to_station", "req_hour", "req_dow"]
ISO_DATE = r"(\d{4})(?:-(\d{2})-|(\d{2}))(\d{2})"
ISO_TIME = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
ISO_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)"
ISO_DATETIME = f"^{ISO_DATE}(?:[T ]{ISO_TIME}({ISO_OFFSET})?)?$"
BAD_ITEM = "Input should be a valid string: departure_datetimes"
BAD_REQUEST = "Malformed request"
ROW_ID = "request_row"


# P1, S6 --------------------------------------------------------------------
def parse_datetime(s: Column) -> Column:
    """ISO date-time, extended or basic, to wall-clock timestamp_ntz; offset
    and 'Z' accepted and discarded (the hour stays as written), digits beyond
    microseconds cut.  Anything not ISO-shaped is NULL (Spark's cast alone
    would accept e.g. '2024')."""
    def part(i: int) -> Column:
        return F.regexp_extract(s, ISO_DATETIME, i)

    def or_zero(i: int) -> Column:
        return F.when(part(i) == "", "00").otherwise(part(i))

    wall = F.concat(part(1), F.lit("-"), part(2), part(3), F.lit("-"), part(4), F.lit(" "), or_zero(5), F.lit(":"),
                    or_zero(6), F.lit(":"), or_zero(7), F.lit("."), F.rpad(F.substring(part(8), 1, 6), 6, "0"))
    return F.when(s.rlike(ISO_DATETIME), wall.try_cast("timestamp_ntz"))


def with_row_id(req: DataFrame) -> DataFrame:
    """An id for every request row that has none yet."""
    return req if ROW_ID in req.columns else req.withColumn(ROW_ID, F.monotonically_increasing_id())


def explode_requests(req: DataFrame) -> DataFrame:
    """One row per (request, position) with the parsed departure time and the
    request-level validation status (400 unreadable request, 422 missing field
    or item, 400 bad datetime); a request with an empty list, or an unreadable
    one, has one row without a position.

    The first bad datetime is looked up in the request's own array, before it
    is exploded, so no request is gathered again."""
    times = F.col("departure_datetimes")
    null_item = F.exists(times, lambda x: x.isNull())
    bad = F.get(F.filter(times, lambda x: x.isNotNull() & parse_datetime(x).isNull()), F.lit(0))
    missing = (F.when(F.col("from_tiploc").isNull(), "from_tiploc")
               .when(F.col("to_tiploc").isNull(), "to_tiploc")
               .when(times.isNull(), "departure_datetimes"))
    torn = F.col("malformed").isNotNull() if "malformed" in req.columns else F.lit(False)
    status = F.when(torn, 400).when(missing.isNotNull() | null_item, 422).when(bad.isNotNull(), 400)
    error = (F.when(torn, BAD_REQUEST)
             .when(missing.isNotNull(), F.concat(F.lit("Field required: "), missing))
             .when(null_item, BAD_ITEM)
             .when(bad.isNotNull(), F.concat(F.lit("Invalid datetime format: "), bad)))
    rows = with_row_id(req).withColumns({"status": status, "error": error})
    rows = rows.select("*", F.posexplode_outer(F.when(~torn, times)).alias("pos", "departure_datetime"))
    return rows.drop("departure_datetimes", "malformed").withColumn("departure_ts", parse_datetime(F.col("departure_datetime")))


# P2 ------------------------------------------------------------------------
def code_dimension(stations: DataFrame) -> DataFrame:
    """code -> (station_name, latitude, longitude); the smallest name wins
    when two stations share a code."""
    return (stations.where(F.col("tiploc").isNotNull()).groupBy("tiploc")
            .agg(F.min_by(F.struct("station_name", "latitude", "longitude"),
                          F.col("station_name")).alias("s"))
            .select("tiploc", "s.*"))


def resolve_codes(rows: DataFrame, stations: DataFrame) -> DataFrame:
    dim = small_side(code_dimension(stations), "station_codes")
    f = dim.select(F.col("tiploc").alias("__f"), F.col("station_name").alias("from_station"),
                   F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon"))
    t = dim.select(F.col("tiploc").alias("__t"), F.col("station_name").alias("to_station"),
                   F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon"))
    out = (rows.join(f, rows["from_tiploc"] == f["__f"], "left")
           .join(t, rows["to_tiploc"] == t["__t"], "left").drop("__f", "__t"))
    ok = F.col("status").isNull()
    status = (F.when(~ok, F.col("status"))
              .when(F.col("from_station").isNull() | F.col("to_station").isNull(), 404))
    error = (F.when(~ok, F.col("error"))
             .when(F.col("from_station").isNull(),
                   F.concat(F.lit("Station not found for TIPLOC: "), F.col("from_tiploc")))
             .when(F.col("to_station").isNull(),
                   F.concat(F.lit("Station not found for TIPLOC: "), F.col("to_tiploc"))))
    return out.withColumns({"status": status, "error": error})


def request_time_keys(rows: DataFrame, dow: str = "sunday0") -> DataFrame:
    """Adds req_hour and req_dow in the weekday numbering of the lookups.

    ``dow="sunday0"`` asks the tables in their own numbering; ``"reference"``
    asks with Monday=0 against Sunday=0 tables, as the reference service does
    (every request then reads the previous day's patterns)."""
    ts = F.col("departure_ts")
    if dow == "sunday0":
        d = tm.weekday_sunday0(ts)
    elif dow == "reference":
        d = tm.weekday_monday0(ts)
    else:
        raise ValueError(f"unknown weekday mode {dow!r}")
    return rows.withColumns({"req_hour": F.hour(ts), "req_dow": d})


# P3 ------------------------------------------------------------------------
_ROUTE = ["frequency", "headcode", "rsid", "next_stop", "r_dow", "r_hour"]


def _route_order(m: Column, *before: Column) -> Column:
    """Frequency desc, then headcode, rsid, next stop, weekday, hour: a total
    order on route rows."""
    return F.struct(*before, -m["frequency"], *[m[c] for c in _ROUTE[1:]])


def _roll_up(best: DataFrame, keys: list[str]) -> DataFrame:
    """The best route per fewer keys, from the best routes per more keys."""
    return best.groupBy(*keys).agg(F.min_by("m", _route_order(F.col("m"))).alias("m"))


def _nearest_by_hour(best: DataFrame, keys: list[str]) -> DataFrame:
    """For every hour 0..23, the candidate nearest to it (no wrap at
    midnight), then the route order.  ``best`` holds at most one row per
    (keys, route hour), so this is at most 24 x 24 rows per key and does not
    grow with the number of requests."""
    m = F.col("m")
    x = best.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("__hh"))
    order = _route_order(m, F.abs(m["r_hour"] - F.col("__hh")))
    return x.groupBy(*keys, "__hh").agg(F.min_by(m, order).alias("m"))


def match_service(keys: DataFrame, routes: DataFrame) -> DataFrame:
    """Four-tier service match for distinct request keys.

    1 origin+destination+hour+weekday; 2 origin+destination, nearest hour
    (time_fallback); 3 origin+hour+weekday (route_fallback); 4 origin,
    nearest hour (fallback).  Frequency descending inside each tier.

    Every tier is an equi-join with at most one partner: tiers 1 and 3 join
    the best route per exact key, tiers 2 and 4 join a precomputed
    nearest-route-per-hour table on the request hour clamped to 0..23 (an
    hour below 0 orders the candidates exactly as hour 0 does, one above 23
    as hour 23).  The routes, of the origins asked for only, are read once:
    the tier-1 table is stored and the other three are rolled up from it.
    """
    keys = keys.select(*REQUEST_KEY).distinct().withColumn(
        "__hc", F.least(F.greatest(F.col("req_hour"), F.lit(0)), F.lit(23)))
    asked = keys.select(F.col("from_station").alias("stationName_from")).distinct()
    m = F.struct("frequency", "headcode", "rsid", F.col("stationName_to").alias("next_stop"),
                 F.col("day_of_week").alias("r_dow"), F.col("hour").alias("r_hour"))
    fr, to = F.col("stationName_from"), F.col("stationName_to")
    exact = (routes.join(asked, "stationName_from", "left_semi").withColumn("m", m)
             .groupBy("stationName_from", "stationName_to", "hour", "day_of_week")
             .agg(F.min_by("m", _route_order(F.col("m"))).alias("m")))
    exact = small_side(exact, "tier1")
    per_day = _roll_up(exact, ["stationName_from", "hour", "day_of_week"])
    t1 = exact.select(fr.alias("__f1"), to.alias("__t1"), F.col("hour").alias("__h1"),
                      F.col("day_of_week").alias("__d1"), F.col("m").alias("m1"))
    t2 = _nearest_by_hour(_roll_up(exact, ["stationName_from", "stationName_to", "hour"]),
                          ["stationName_from", "stationName_to"]).select(
        fr.alias("__f2"), to.alias("__t2"), F.col("__hh").alias("__h2"), F.col("m").alias("m2"))
    t3 = per_day.select(fr.alias("__f3"), F.col("hour").alias("__h3"), F.col("day_of_week").alias("__d3"),
                        F.col("m").alias("m3"))
    t4 = _nearest_by_hour(_roll_up(per_day, ["stationName_from", "hour"]), ["stationName_from"]).select(
        fr.alias("__f4"), F.col("__hh").alias("__h4"), F.col("m").alias("m4"))
    c = F.col
    j = (keys.join(t1, (c("from_station") == c("__f1")) & (c("to_station") == c("__t1"))
                   & (c("req_hour") == c("__h1")) & (c("req_dow") == c("__d1")), "left")
         .join(t2, (c("from_station") == c("__f2")) & (c("to_station") == c("__t2"))
               & (c("__hc") == c("__h2")), "left")
         .join(t3, (c("from_station") == c("__f3")) & (c("req_hour") == c("__h3"))
               & (c("req_dow") == c("__d3")), "left")
         .join(t4, (c("from_station") == c("__f4")) & (c("__hc") == c("__h4")), "left"))
    tier = (F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2)
            .when(F.col("m3").isNotNull(), 3).when(F.col("m4").isNotNull(), 4))
    best = F.coalesce("m1", "m2", "m3", "m4")
    return j.select(*REQUEST_KEY, best["headcode"].alias("headcode"), best["rsid"].alias("rsid"),
                    best["next_stop"].alias("next_stop"), best["frequency"].alias("frequency"),
                    tier.alias("match_tier"))


def match_flags(tier: Column) -> dict[str, Column]:
    """The response's flags, as the texts ``True`` and ``False``."""
    def text(which: int) -> Column:
        return F.when(tier == which, "True").otherwise("False")
    return {"time_fallback": text(2), "route_fallback": text(3), "fallback_used": text(4)}


# P4 ------------------------------------------------------------------------
def arrival_state(rows: DataFrame, hist: DataFrame) -> DataFrame:
    """Historical averages for (headcode, rsid, origin, weekday, time bucket);
    a found row gives its values (NULL -> 0), no row gives the defaults."""
    h = hist.select(F.col("headcode").alias("__hc"), F.col("rsid").alias("__rs"),
                    F.col("station_of_arrival").alias("__st"),
                    F.col("day_of_week_bucket").alias("__dw"),
                    F.col("time_of_day_bucket").alias("__tb"), F.lit(True).alias("__hit"),
                    *[F.col(c) for c in HIST_DEFAULTS])
    cond = ((F.col("headcode") == F.col("__hc")) & (F.col("rsid") == F.col("__rs"))
            & (F.col("from_station") == F.col("__st")) & (F.col("req_dow") == F.col("__dw"))
            & (tm.time_bucket(F.col("req_hour")) == F.col("__tb")))
    j = rows.join(h, cond, "left")
    vals = {c: F.when(F.col("__hit"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
            .otherwise(F.lit(d)) for c, d in HIST_DEFAULTS.items()}
    return j.withColumns(vals).drop("__hc", "__rs", "__st", "__dw", "__tb", "__hit")


# P5, P6 --------------------------------------------------------------------
def fan_out(rows: DataFrame, classes: list[str] | None = None) -> DataFrame:
    return rows.withColumn("coach_type", F.explode(F.array(*[F.lit(c) for c in
                                                             (classes or SERVICE_CLASSES)])))


def serving_features(rows: DataFrame, skew: str | None = None) -> DataFrame:
    """Model features of one (request time, class) row.

    ``skew=None`` computes time period, distance and city flags exactly as in
    training; ``skew="reference"`` reproduces the serving-side forms
    (left-closed periods, planar distance, substring flags)."""
    ts = F.col("departure_ts")
    ct = F.col("coach_type")
    std = ct == "Standard"
    first = ct == "First Class"
    cap = F.when(std, CAPACITY["Standard"]).when(first, CAPACITY["First Class"]) \
        .otherwise(CAPACITY["other"])
    den_std = F.when(std, CAPACITY["Standard"]).otherwise(CAPACITY["First Class"])
    den_first = F.when(first, CAPACITY["First Class"]).otherwise(CAPACITY["Standard"])
    den_total = F.when(std, CAPACITY["Standard"]).otherwise(CAPACITY["other"])
    a_std = F.col("avg_vehicle_pax_on_arrival_std")
    a_first = F.col("avg_vehicle_pax_on_arrival_first")
    board = F.col("avg_unit_boarders_at_station")
    alight = F.col("avg_unit_alighters_at_station")
    hour = F.hour(ts)
    dow = tm.weekday_monday0(ts)
    ref = skew == "reference"
    period = tm.time_period_serve(hour) if ref else tm.time_period_train(hour)
    dist = geo.planar_km if ref else geo.haversine_km
    match = "contains" if ref else "exact"
    london = fe.LONDON_SUBSTRINGS if ref else fe.LONDON_STATIONS
    major = fe.MAJOR_CITY_SUBSTRINGS if ref else fe.MAJOR_CITY_STATIONS
    fl, fm = fe.city_flags(F.col("from_station"), london, major, match)
    tl, tmj = fe.city_flags(F.col("to_station"), london, major, match)
    total = a_std + a_first
    pct = lambda num, den: num / den * F.lit(100.0)
    return rows.withColumns({
        "hour_of_day": hour, "day_of_week": dow, "month": F.month(ts),
        "is_weekend": tm.is_weekend(dow), "is_peak_hour": tm.is_peak_hour(hour),
        "time_period": period,
        "route_distance_km": dist(F.col("from_lat"), F.col("from_lon"),
                                  F.col("to_lat"), F.col("to_lon")),
        "from_london": fl, "to_london": tl, "from_major_city": fm, "to_major_city": tmj,
        "vehicle_capacity": cap,
        "vehicle_pax_on_arrival_std_at_from": a_std,
        "vehicle_pax_on_arrival_first_at_from": a_first,
        "totalUnitPassenger_at_leg_departure": F.col("avg_total_unit_pax_on_arrival"),
        "onUnitPassenger_at_from_station": board,
        "offUnitPassenger_at_from_station": alight,
        "vehicle_pax_boarded_std_at_from": board * F.lit(BOARD_SPLIT[0]),
        "vehicle_pax_boarded_first_at_from": board * F.lit(BOARD_SPLIT[1]),
        "vehicle_pax_alighted_std_at_from": alight * F.lit(BOARD_SPLIT[0]),
        "vehicle_pax_alighted_first_at_from": alight * F.lit(BOARD_SPLIT[1]),
        "occupancy_percentage_std": pct(a_std, den_std),
        "occupancy_percentage_first": pct(a_first, den_first),
        "total_occupancy": total,
        "total_occupancy_percentage": pct(total, den_total),
        "boarding_ratio": pct(board, den_total),
        "alighting_ratio": pct(alight, den_total),
        "capacity_utilization": pct(total, den_total),
    }).withColumns({"stationName_from": F.col("from_station"),
                    "stationName_to": F.col("to_station")})


def apply_serving_labels(rows: DataFrame, labels: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Label codes with unseen values coded 0."""
    return fe.apply_labels(rows, labels, cols or fe.ENCODED_COLUMNS, unknown=0)


# P7 ------------------------------------------------------------------------
def pick_class(df: DataFrame, prob: str = "probability", prefix: str = "") -> DataFrame:
    """argmax (first on ties) of the class probabilities, max as confidence,
    numeric score Busy 1, Moderate 2, Quiet 3."""
    p = F.col(prob)
    idx = F.array_position(p, F.array_max(p))  # 1-based, first maximum
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    scores = F.array(*[F.lit(NUMERIC_SCORE[c]) for c in CLASS_NAMES])
    return df.withColumns({
        f"{prefix}comfort_tier": F.element_at(names, idx.cast("int")),
        f"{prefix}confidence": F.array_max(p),
        f"{prefix}numeric_score": F.element_at(scores, idx.cast("int")),
    })


# P8, P9, P12 ---------------------------------------------------------------
def iso_text(ts: Column, raw: Column) -> Column:
    """Departure time as the reference prints it: ISO wall clock, the given
    offset kept ('Z' printed as +00:00)."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    base = F.when(frac != "000000", F.concat(base, F.lit("."), frac)).otherwise(base)
    off = F.regexp_replace(F.regexp_extract(raw, ISO_DATETIME, 9), ":", "")
    off = (F.when(off.isin("Z", "-00", "-0000"), "+00:00")
           .when(F.length(off) == 3, F.concat(off, F.lit(":00")))
           .when(F.length(off) == 5, F.concat(F.substring(off, 1, 3), F.lit(":"), F.substring(off, 4, 2)))
           .when(F.length(off) == 7, F.concat_ws(":", F.substring(off, 1, 3), F.substring(off, 4, 2), F.substring(off, 6, 2)))
           .otherwise(off))
    return F.concat(base, off)


CLASS_PREFIX = {"Standard": "standard", "First Class": "first"}


def score_classes(rows: DataFrame, model, labels: DataFrame, feature_list: list[str],
                  skew: str | None = None) -> DataFrame:
    """P5-P7 with both classes in one row: for each class its features, the
    model, and <prefix>_tier, <prefix>_confidence, <prefix>_score.  Labels
    that don't depend on the class are looked up once."""
    common = [c for c in fe.ENCODED_COLUMNS if c != "coach_type"]
    rows = rows.withColumn("coach_type", F.lit(SERVICE_CLASSES[0]))
    rows = apply_serving_labels(serving_features(rows, skew), labels, common)
    kept, codes = rows.columns, small_side(labels.where(F.col("column") == "coach_type"), "class_codes")
    for name in SERVICE_CLASSES:
        one = serving_features(rows.withColumn("coach_type", F.lit(name)), skew)
        one = model.predict_classes(apply_serving_labels(one, codes, ["coach_type"]), feature_list)
        one = pick_class(one, prefix="__")
        new = {"tier": "__comfort_tier", "confidence": "__confidence", "score": "__numeric_score"}
        rows = one.select(*kept, *[F.col(c).alias(f"{CLASS_PREFIX[name]}_{k}") for k, c in new.items()])
        kept = rows.columns
    return rows


def score(requests: DataFrame, lookups: dict[str, DataFrame], model, labels: DataFrame,
          feature_list: list[str], dow: str = "sunday0", skew: str | None = None) -> DataFrame:
    """Flat response: one row per (request, departure) with both classes, one
    row without a position for a request that asks nothing, or one error row
    per failed request (status 400/404/422 and a message).

    A request fails as a whole.  All of its rows agree on that: validation and
    codes are the request's own, and a service is missing for one departure
    only if the origin has no route at all, hence for all.  So the first row
    stands for a failed request and no request is gathered."""
    rows = request_time_keys(resolve_codes(explode_requests(requests), lookups["stations"]), dow)
    # request rows are numbered once; both uses below read the same numbers
    rows = small_side(rows, "request_rows")
    asking = F.col("status").isNull() & F.col("pos").isNotNull()
    matched = match_service(rows.where(asking), lookups["service_routes_summary_mvp"])
    rows = rows.join(matched, REQUEST_KEY, "left")
    lost = asking & F.col("match_tier").isNull()
    rows = rows.withColumns({
        "error": F.when(lost, F.concat(F.lit("No services found from "), F.col("from_station"))).otherwise(F.col("error")),
        "status": F.coalesce("status", F.when(lost, 404).otherwise(200))})
    first = F.coalesce("pos", F.lit(0)) == 0
    good = arrival_state(rows.where((F.col("status") == 200) & F.col("pos").isNotNull()), lookups["historical_averages"])
    good = score_classes(good, model, labels, feature_list, skew)
    picked = [f"{p}_{m}" for p in CLASS_PREFIX.values() for m in ("tier", "confidence", "score")]
    good = good.select(
        ROW_ID, "request_id", "pos", "from_tiploc", "to_tiploc", "from_station", "to_station",
        iso_text(F.col("departure_ts"), F.col("departure_datetime")).alias("departure_datetime"),
        "headcode", "rsid", "next_stop", *[v.alias(k) for k, v in match_flags(F.col("match_tier")).items()],
        "status", "error", *picked)
    rest = rows.where(first & ((F.col("status") != 200) | F.col("pos").isNull())).select(
        ROW_ID, "request_id", "from_tiploc", "to_tiploc", "status", "error")
    return good.unionByName(rest, allowMissingColumns=True)


def nest(flat: DataFrame) -> DataFrame:
    """P8 nested form: one row per request row with its predictions in request
    order.  The list holds a request's own departures only, which one input
    row held before; requests that repeat an id stay apart (by the row id that
    ``score`` gives; a table without it has one request per ``request_id``)."""
    item = F.struct(
        "pos", "from_tiploc", "to_tiploc", "from_station", "to_station", "departure_datetime",
        F.struct(F.col("standard_tier").alias("comfort_tier"),
                 F.col("standard_confidence").alias("confidence"),
                 F.col("standard_score").alias("numeric_score")).alias("standard_class"),
        F.struct(F.col("first_tier").alias("comfort_tier"),
                 F.col("first_confidence").alias("confidence"),
                 F.col("first_score").alias("numeric_score")).alias("first_class"),
        F.struct("headcode", "rsid", "next_stop", "fallback_used", "time_fallback",
                 "route_fallback").alias("service_info"))
    row = [ROW_ID] if ROW_ID in flat.columns else []
    out = flat.groupBy(*row, "request_id", "status", "error").agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("predictions"))
    return out.select("request_id", "status", "error",
                      F.when(F.col("status") == 200, F.col("predictions")).alias("predictions"))


def write_predictions(flat: DataFrame, path: str, fmt: str = "json") -> None:
    """The nested response (one line per request, predictions in
    request order), published under ``path`` in place of the one before."""
    publish({"predictions": nest(flat)}, path, fmt)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The published response."""
    return read_published(spark, path, ["predictions"])["predictions"]


# P10, P11 ------------------------------------------------------------------
def list_stations(stations: DataFrame) -> DataFrame:
    return (stations.where(F.col("tiploc").isNotNull()).select("tiploc", "station_name")
            .orderBy("station_name", "tiploc"))


def list_codes(stations: DataFrame) -> DataFrame:
    return (stations.where(F.col("tiploc").isNotNull())
            .select("tiploc", "station_name", "tiploc_orig_desc", "tiploc_orig_tps_desc")
            .orderBy("tiploc", "station_name"))
