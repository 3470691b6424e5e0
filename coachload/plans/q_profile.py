"""Registered profiling queries (E1-E14) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from coachload.operators import profile as pr
from coachload.plans import sqlparts as sq
from coachload.session import materialize
from coachload.sources import tables

TARGET = "relevant_passengers_on_leg_departure"
FIELDS = tables.LEGS_SCHEMA.fields
NUMERIC = [f.name for f in FIELDS if f.dataType.simpleString() in ("bigint", "double")]
STRINGS = [f.name for f in FIELDS if f.dataType.simpleString() == "string"]


def _legs(spark, sf_dir):
    return tables.legs(spark, sf_dir)


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def q_columns(spark, sf_dir):
    return pr.column_profile(_legs(spark, sf_dir))


def q_head(spark, sf_dir):
    return pr.head_rows(_legs(spark, sf_dir), 5, tables.LEG_KEY)


def q_missing(spark, sf_dir):
    return pr.missing_report(_legs(spark, sf_dir))


def q_numeric(spark, sf_dir):
    s = pr.numeric_summary(_legs(spark, sf_dir))
    return s.select("column_name", "count", *[r6(c) for c in
                                              ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_top_values(spark, sf_dir):
    return pr.top_values(_legs(spark, sf_dir))


def q_span(spark, sf_dir):
    return pr.date_span(_legs(spark, sf_dir))


def q_target_stats(spark, sf_dir):
    s = pr.target_stats(_legs(spark, sf_dir))
    return s.select(*[r6(c) for c in s.columns])


def q_outliers(spark, sf_dir):
    o = pr.iqr_outliers(_legs(spark, sf_dir))
    return o.select(*[r6(c) if c != "outliers" else F.col(c) for c in o.columns])


def q_top_station(col):
    def run(spark, sf_dir):
        return pr.value_counts(_legs(spark, sf_dir), col, 10, out="station")
    return run


def q_coach(spark, sf_dir):
    return pr.value_counts(_legs(spark, sf_dir), "coach_type")


def q_hour(spark, sf_dir):
    return pr.by_hour(_legs(spark, sf_dir))


def q_day(spark, sf_dir):
    return pr.by_day_name(_legs(spark, sf_dir))


def q_corr(spark, sf_dir):
    return pr.correlations(_legs(spark, sf_dir), TARGET).select("column_name", r6("correlation"))


def q_dups(spark, sf_dir):
    return pr.duplicate_count(_legs(spark, sf_dir))


def q_quality(spark, sf_dir):
    # quartiles, counts and copies read the legs six times: they are written once
    q = pr.quality_summary(tables.stored_legs(spark, sf_dir, _legs(spark, sf_dir).columns), TARGET)
    return q.withColumn("outlier_percentage", F.round("outlier_percentage", 6))


def q_one_scan(spark, sf_dir):
    """E1, E2, E5 and E12, gathered while the legs are written."""
    legs = _legs(spark, sf_dir)
    reports = pr.ScanReports(legs, TARGET, "leg_departure_dt")
    materialize(reports.watch(legs), "legs")
    t = reports.tables()
    dates = t["dates"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("value"))
                                                  for c in ("first", "last")])).alias("x")).select(F.lit("dates").alias("report"), "x.name", "x.value")
    counts = t["columns"].select(F.lit("columns").alias("report"), F.col("column_name").alias("name"),
                                 F.concat_ws("/", "data_type", "non_null_count", "row_count").alias("value"))
    missing = t["missing"].select(F.lit("missing").alias("report"), F.col("column_name").alias("name"), F.col("missing_count").cast("string").alias("value"))
    corr = t["correlations"].select(F.lit("correlations").alias("report"), F.col("column_name").alias("name"),
                                    F.format_string("%.5f", F.round("correlation", 5)).alias("value"))
    return counts.unionByName(missing).unionByName(dates).unionByName(corr)


QUERIES = {
    "profile_one_scan": q_one_scan,
    "profile_columns": q_columns,
    "profile_head": q_head,
    "profile_missing": q_missing,
    "profile_numeric_summary": q_numeric,
    "profile_top_values": q_top_values,
    "profile_date_span": q_span,
    "profile_target_stats": q_target_stats,
    "profile_outliers": q_outliers,
    "profile_top_origins": q_top_station("stationName_from"),
    "profile_top_destinations": q_top_station("stationName_to"),
    "profile_coach_counts": q_coach,
    "profile_by_hour": q_hour,
    "profile_by_day": q_day,
    "profile_correlations": q_corr,
    "profile_duplicates": q_dups,
    "profile_quality": q_quality,
}

_UA = "\nUNION ALL\n"
_Q = (f"q AS (SELECT quantile_cont({TARGET}, 0.25) AS q1, quantile_cont({TARGET}, 0.75) AS q3 FROM legs)",
      "b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)")
_OUTLIERS = (f"(SELECT COUNT(*) FROM legs, b WHERE {TARGET} < b.lo OR {TARGET} > b.hi)")

ORACLES = {
    "profile_one_scan": sq.legs_only(body=_UA.join(
        [f"SELECT 'columns' AS report, '{f.name}' AS name, '{f.dataType.simpleString()}/' || COUNT({f.name}) || '/' || COUNT(*) AS value FROM legs"
         for f in FIELDS]
        + [f"SELECT 'missing', '{f.name}', CAST(COUNT(*) - COUNT({f.name}) AS VARCHAR) FROM legs HAVING COUNT({f.name}) < COUNT(*)" for f in FIELDS]
        + [f"SELECT 'dates', '{n}', strftime({n[:1] == 'f' and 'min' or 'max'}(leg_departure_dt), '%Y-%m-%d %H:%M:%S') FROM legs" for n in ("first", "last")]
        + [f"SELECT 'correlations', '{c}', printf('%.5f', round(corr(CAST({c} AS DOUBLE), {TARGET}), 5)) FROM legs" for c in NUMERIC if c != TARGET])),
    "profile_columns": sq.legs_only(body=_UA.join(
        f"SELECT {i} AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type, "
        f"COUNT({f.name}) AS non_null_count, COUNT(*) AS row_count FROM legs"
        for i, f in enumerate(FIELDS))),
    "profile_head": sq.legs_only(body="SELECT * FROM legs ORDER BY messageId_leg_start, leg_departure_dt LIMIT 5"),
    "profile_missing": sq.legs_only(
        "m AS (" + _UA.join(
            f"SELECT '{f.name}' AS column_name, COUNT(*) FILTER (WHERE {f.name} IS NULL) AS missing_count, "
            f"CAST(COUNT(*) FILTER (WHERE {f.name} IS NULL) AS DOUBLE) / COUNT(*) * 100.0 AS missing_percentage "
            "FROM legs" for f in FIELDS) + ")",
        body="SELECT * FROM m WHERE missing_count > 0"),
    "profile_numeric_summary": sq.legs_only(body=_UA.join(
        f"SELECT '{c}' AS column_name, COUNT({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
        f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM legs"
        for c in NUMERIC)),
    "profile_top_values": sq.legs_only(
        "c AS (" + _UA.join(
            f"SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS count FROM legs "
            f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in STRINGS) + ")",
        "r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank FROM c)",
        body="SELECT * FROM r WHERE rank <= 10"),
    "profile_date_span": sq.legs_only(body=(
        "SELECT min(leg_departure_dt) AS first, max(leg_departure_dt) AS last, "
        "CAST(floor((epoch(max(leg_departure_dt)) - epoch(min(leg_departure_dt))) / 86400) AS BIGINT) AS span_days FROM legs")),
    "profile_target_stats": sq.legs_only(body=(
        f"SELECT round(min({TARGET}), 6) AS min, round(max({TARGET}), 6) AS max, round(avg({TARGET}), 6) AS mean, "
        f"round(quantile_cont({TARGET}, 0.5), 6) AS median, round(stddev_samp({TARGET}), 6) AS std FROM legs")),
    "profile_outliers": sq.legs_only(*_Q, body=(
        "SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lower_bound, "
        f"round(hi, 6) AS upper_bound, {_OUTLIERS} AS outliers, "
        f"round(CAST({_OUTLIERS} AS DOUBLE) / (SELECT COUNT(*) FROM legs) * 100.0, 6) AS outlier_percentage FROM b")),
    "profile_top_origins": sq.legs_only(body=(
        "SELECT stationName_from AS station, COUNT(*) AS count FROM legs WHERE stationName_from IS NOT NULL "
        "GROUP BY 1 ORDER BY count DESC, station LIMIT 10")),
    "profile_top_destinations": sq.legs_only(body=(
        "SELECT stationName_to AS station, COUNT(*) AS count FROM legs WHERE stationName_to IS NOT NULL "
        "GROUP BY 1 ORDER BY count DESC, station LIMIT 10")),
    "profile_coach_counts": sq.legs_only(body=(
        "SELECT coach_type, COUNT(*) AS count FROM legs WHERE coach_type IS NOT NULL GROUP BY 1")),
    "profile_by_hour": sq.legs_only(body=(
        f"SELECT {sq.hour('leg_departure_dt')} AS hour, COUNT(*) AS count FROM legs GROUP BY 1 ORDER BY 1 LIMIT 10")),
    "profile_by_day": sq.legs_only(body=(
        "SELECT dayname(leg_departure_dt) AS day_name, COUNT(*) AS count FROM legs GROUP BY 1")),
    "profile_correlations": sq.legs_only(body=_UA.join(
        f"SELECT '{c}' AS column_name, round(corr(CAST({c} AS DOUBLE), {TARGET}), 6) AS correlation FROM legs"
        for c in NUMERIC if c != TARGET)),
    "profile_duplicates": sq.legs_only(
        "g AS (SELECT COUNT(*) AS n FROM legs GROUP BY ALL_COLS)".replace(
            "ALL_COLS", ", ".join(f.name for f in FIELDS)),
        body="SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows FROM g"),
    "profile_quality": sq.legs_only(
        *_Q, "g AS (SELECT COUNT(*) AS n FROM legs GROUP BY ALL_COLS)".replace(
            "ALL_COLS", ", ".join(f.name for f in FIELDS)),
        body=(f"SELECT COUNT(*) AS total_records, {len(FIELDS)} AS total_features, "
              f"{len(NUMERIC)} AS numerical_features, {len(STRINGS)} AS categorical_features, "
              "CAST(" + " + ".join(f"COUNT(*) FILTER (WHERE {f.name} IS NULL)" for f in FIELDS)
              + " AS BIGINT) AS missing_values, "
              "(SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM g) AS duplicate_rows, "
              f"min({TARGET}) AS target_min, max({TARGET}) AS target_max, "
              f"{_OUTLIERS} AS outliers, "
              f"round(CAST({_OUTLIERS} AS DOUBLE) / COUNT(*) * 100.0, 6) AS outlier_percentage FROM legs")),
}
