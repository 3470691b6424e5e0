"""Registered feature queries (F1-F18) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from coachload.operators import features as fe, target as tg
from coachload.plans import sqlparts as sq
from coachload.session import materialize
from coachload.sources import tables

KEY = tables.LEG_KEY
TIME_COLS = ["hour_of_day", "day_of_week", "month", "day_of_month", "is_weekend",
             "time_period", "is_peak_hour"]
LOC_COLS = ["from_lat", "from_lon", "to_lat", "to_lon", "route_distance_km", "from_london",
            "to_london", "from_major_city", "to_major_city"]
OCC_COLS = ["occupancy_percentage_std", "occupancy_percentage_first", "total_occupancy",
            "total_occupancy_percentage", "boarding_ratio", "alighting_ratio",
            "capacity_utilization"]


def _legs(spark, sf_dir):
    return tables.legs(spark, sf_dir)


def q_time(period):
    def run(spark, sf_dir):
        return fe.add_time_features(_legs(spark, sf_dir), period=period).select(*KEY, *TIME_COLS)
    return run


def q_location(match, distance):
    def run(spark, sf_dir):
        df = fe.add_location_features(_legs(spark, sf_dir), match=match, distance=distance)
        return df.select(*KEY, *[F.round(c, 6).alias(c) if c == "route_distance_km" else c
                                 for c in LOC_COLS])
    return run


def q_occupancy(spark, sf_dir):
    return fe.add_occupancy(_legs(spark, sf_dir), utilization=True).select(*KEY, *OCC_COLS)


def _engineered(spark, sf_dir):
    """The legs are written once: the dictionary, the thresholds and the
    features each read the columns they need."""
    legs = tables.stored_legs(spark, sf_dir, tables.legs(spark, sf_dir).columns)
    feats, labels = fe.engineer(legs)
    thresholds = materialize(tg.thresholds(tg.occupancy_pct(legs)), "thresholds")
    return tg.encode_tier(tg.assign_tier(tg.occupancy_pct(feats), thresholds)), labels


def q_dictionary(spark, sf_dir):
    return fe.fit_labels(fe.add_time_features(_legs(spark, sf_dir)))


def q_encoded(spark, sf_dir):
    df, _ = _engineered(spark, sf_dir)
    return df.select(*KEY, *[c + "_encoded" for c in fe.ENCODED_COLUMNS])


def q_matrix(spark, sf_dir):
    df, _ = _engineered(spark, sf_dir)
    x, available, _ = fe.select_features(df, keep=KEY)
    return x.withColumn("route_distance_km", F.round("route_distance_km", 6))


def q_missing(spark, sf_dir):
    df, _ = _engineered(spark, sf_dir)
    x, available, _ = fe.select_features(df, label=None)
    return fe.missing_counts(x, available)


def q_aligned(spark, sf_dir):
    df, _ = _engineered(spark, sf_dir)
    out = fe.align(df, KEY + fe.selected_features())
    return out.withColumn("route_distance_km", F.round("route_distance_km", 6))


def q_groups(spark, sf_dir):
    """the selected names by group, and which the feature table has."""
    df, _ = _engineered(spark, sf_dir)
    return fe.feature_group_table(spark, df.columns)


def q_before_departure(spark, sf_dir):
    """The feature table without the columns that leak the target."""
    df, _ = _engineered(spark, sf_dir)
    x, _, _ = fe.select_features(df, fe.groups_before_departure(), keep=KEY)
    return x.withColumn("route_distance_km", F.round("route_distance_km", 6))


def _new_columns(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    after = fe.engineer(legs)[0]
    return legs, after, [c for c in after.columns if c not in legs.columns]


def q_summary(spark, sf_dir):
    legs, after, _ = _new_columns(spark, sf_dir)
    return fe.feature_summary(legs, after)


def q_sample(spark, sf_dir):
    """The dictionary is that of all legs; only the first rows by key get
    their features."""
    legs = _legs(spark, sf_dir)
    after, labels = fe.engineer(legs)
    new = [c for c in after.columns if c not in legs.columns]
    first = fe.engineer(materialize(legs.orderBy(*KEY).limit(5), "first_legs"), labels)[0]
    return fe.feature_sample(first, new, KEY).withColumn("route_distance_km", F.round("route_distance_km", 6))


QUERIES = {
    "features_time": q_time("train"),
    "features_time_serving": q_time("serve"),
    "features_location": q_location("exact", "haversine"),
    "features_location_serving": q_location("contains", "planar"),
    "features_occupancy": q_occupancy,
    "features_label_dictionary": q_dictionary,
    "features_encoded": q_encoded,
    "features_matrix": q_matrix,
    "features_missing": q_missing,
    "features_aligned": q_aligned,
    "features_groups": q_groups,
    "features_before_departure": q_before_departure,
    "features_summary": q_summary,
    "features_sample": q_sample,
}

# --- oracle texts -----------------------------------------------------------
_K = "messageId_leg_start, leg_departure_dt"


def _coord(loc: str, i: int) -> str:
    return f"COALESCE(CAST(NULLIF(string_split({loc}, ',')[{i + 1}], '') AS DOUBLE), {54.0 if i == 0 else -2.0})"


def _haversine(a1, o1, a2, o2):
    return (f"2 * 6371.0 * asin(sqrt(pow(sin((radians({a2}) - radians({a1})) / 2), 2) + "
            f"cos(radians({a1})) * cos(radians({a2})) * pow(sin((radians({o2}) - radians({o1})) / 2), 2)))")


def _planar(a1, o1, a2, o2):
    return f"sqrt(pow({a2} - {a1}, 2) + pow({o2} - {o1}, 2)) * 111.0"


def _flags(match: str) -> str:
    """The names are the operators' fixed lists."""
    if match == "exact":
        def flag(c, names):
            return f"CAST(CASE WHEN {c} IN (" + ", ".join(f"'{n}'" for n in names) + ") THEN 1 ELSE 0 END AS INTEGER)"
        london, major = fe.LONDON_STATIONS, fe.MAJOR_CITY_STATIONS
    else:
        def flag(c, words):
            return "CAST(CASE WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words) + " THEN 1 ELSE 0 END AS INTEGER)"
        london, major = fe.LONDON_SUBSTRINGS, fe.MAJOR_CITY_SUBSTRINGS
    return (f"{flag('stationName_from', london)} AS from_london, {flag('stationName_to', london)} AS to_london, "
            f"{flag('stationName_from', major)} AS from_major_city, {flag('stationName_to', major)} AS to_major_city")


def _loc_cte(src: str, match: str = "exact", distance: str = "haversine", name: str = "loc") -> str:
    return (f"{name}0 AS (SELECT {src}.*, {_coord('stationLocation_from', 0)} AS from_lat, "
            f"{_coord('stationLocation_from', 1)} AS from_lon, {_coord('stationLocation_to', 0)} AS to_lat, "
            f"{_coord('stationLocation_to', 1)} AS to_lon FROM {src}),\n"
            f"{name} AS (SELECT {name}0.*, "
            f"{(_haversine if distance == 'haversine' else _planar)('from_lat', 'from_lon', 'to_lat', 'to_lon')} AS route_distance_km, "
            f"{_flags(match)} FROM {name}0)")


def _occ_cte(src: str, name: str = "oc", utilization: bool = False) -> str:
    p = sq.pct
    util = (f", {p('relevant_passengers_on_leg_departure', 'vehicle_capacity')} AS capacity_utilization"
            if utilization else "")
    return (f"{name} AS (SELECT {src}.*, "
            f"{p('vehicle_pax_on_arrival_std_at_from', 'vehicle_capacity')} AS occupancy_percentage_std, "
            f"{p('vehicle_pax_on_arrival_first_at_from', 'vehicle_capacity')} AS occupancy_percentage_first, "
            "vehicle_pax_on_arrival_std_at_from + vehicle_pax_on_arrival_first_at_from AS total_occupancy, "
            f"{p('vehicle_pax_on_arrival_std_at_from + vehicle_pax_on_arrival_first_at_from', 'vehicle_capacity')} AS total_occupancy_percentage, "
            f"{p('vehicle_pax_boarded_std_at_from + vehicle_pax_boarded_first_at_from', 'vehicle_capacity')} AS boarding_ratio, "
            f"{p('vehicle_pax_alighted_std_at_from + vehicle_pax_alighted_first_at_from', 'vehicle_capacity')} AS alighting_ratio"
            f"{util} FROM {src})")


_DICT = ("dict AS (SELECT column_name AS \"column\", value, "
         "CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS code FROM ("
         + " UNION ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM tf WHERE {c} IS NOT NULL"
                          for c in fe.ENCODED_COLUMNS) + ") d)")


def _enc_cte(src: str, name: str = "en") -> str:
    cols = ", ".join(f"(SELECT code FROM dict WHERE \"column\" = '{c}' AND value = CAST({src}.{c} AS VARCHAR)) "
                     f"AS {c}_encoded" for c in fe.ENCODED_COLUMNS)
    return f"{name} AS (SELECT {src}.*, {cols} FROM {src})"


def _engineered_sql(body: str) -> str:
    """time -> location -> occupancy -> encoding -> tiers, as CTEs."""
    ctes = [sq.LEGS_CTE, sq.TIME_FEATURES_CTE, _loc_cte("tf"), _occ_cte("loc"), _DICT, _enc_cte("oc"),
            f"occ AS (SELECT en.*, {sq.pct('relevant_passengers_on_leg_departure', 'vehicle_capacity')} AS occupancy_percentage FROM en)",
            *sq.LABELLED_CTES[1:]]
    return sq.with_ctes(*ctes, body=body)


_AVAILABLE = [f for f in fe.selected_features() if f != "capacity_utilization"]


# Columns that the feature pipeline adds, in order.
NEW = [*TIME_COLS, *LOC_COLS, *[c for c in OCC_COLS if c != "capacity_utilization"], *[c + "_encoded" for c in fe.ENCODED_COLUMNS]]


def _sel(cols):
    return ", ".join("round(route_distance_km, 6) AS route_distance_km" if c == "route_distance_km" else c
                     for c in cols)


ORACLES = {
    "features_time": sq.with_ctes(sq.LEGS_CTE, sq.TIME_FEATURES_CTE,
                                  body=f"SELECT {_K}, {', '.join(TIME_COLS)} FROM tf"),
    "features_time_serving": sq.with_ctes(
        sq.LEGS_CTE, sq.TIME_FEATURES_CTE,
        body=f"SELECT {_K}, " + ", ".join(
            f"{sq.period_serve('hour_of_day')} AS time_period" if c == "time_period" else c
            for c in TIME_COLS) + " FROM tf"),
    "features_location": sq.with_ctes(sq.LEGS_CTE, _loc_cte("legs"),
                                      body=f"SELECT {_K}, {_sel(LOC_COLS)} FROM loc"),
    "features_location_serving": sq.with_ctes(sq.LEGS_CTE, _loc_cte("legs", "contains", "planar"),
                                              body=f"SELECT {_K}, {_sel(LOC_COLS)} FROM loc"),
    "features_occupancy": sq.with_ctes(sq.LEGS_CTE, _occ_cte("legs", utilization=True),
                                       body=f"SELECT {_K}, {', '.join(OCC_COLS)} FROM oc"),
    "features_label_dictionary": sq.with_ctes(sq.LEGS_CTE, sq.TIME_FEATURES_CTE, _DICT,
                                              body="SELECT * FROM dict"),
    "features_encoded": _engineered_sql(
        f"SELECT {_K}, " + ", ".join(c + "_encoded" for c in fe.ENCODED_COLUMNS) + " FROM labe"),
    "features_matrix": _engineered_sql(f"SELECT {_K}, comfort_tier_encoded, {_sel(_AVAILABLE)} FROM labe"),
    "features_missing": _engineered_sql(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM labe"
        for c in _AVAILABLE)),
    "features_groups": "SELECT * FROM (VALUES " + ", ".join(
        f"('{g}', {i}, '{f}', {'FALSE' if f == 'capacity_utilization' else 'TRUE'})"
        for g, fs in fe.FEATURE_GROUPS.items() for i, f in enumerate(fs)) + ") v(feature_group, position, feature, available)",
    "features_before_departure": _engineered_sql(
        f"SELECT {_K}, comfort_tier_encoded, {_sel([c for c in _AVAILABLE if c not in fe.POST_DEPARTURE])} FROM labe"),
    "features_summary": "SELECT * FROM (VALUES " + ", ".join(
        f"('{m}', {i}, '{v}')" for m, i, v in [
            ("original_columns", 0, len(tables.LEGS_SCHEMA)), ("final_columns", 0, len(tables.LEGS_SCHEMA) + len(NEW)),
            ("new_features", 0, len(NEW)), *[("new_column", i + 1, c) for i, c in enumerate(NEW)]]) + ") v(metric, position, value)",
    "features_sample": _engineered_sql(f"SELECT {_K}, {_sel(NEW)} FROM labe ORDER BY {_K} LIMIT 5"),
    "features_aligned": _engineered_sql(
        f"SELECT {_K}, " + ", ".join(
            "0 AS capacity_utilization" if c == "capacity_utilization" else
            ("round(route_distance_km, 6) AS route_distance_km" if c == "route_distance_km" else c)
            for c in fe.selected_features()) + " FROM labe"),
}
