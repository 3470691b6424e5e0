"""Registered target-labelling queries (T1-T14) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from coachload.operators import features as fe, profile as pr, target as tg
from coachload.plans import sqlparts as sq
from coachload.sources import tables

KEY = tables.LEG_KEY


def labelled_legs(spark, sf_dir, columns=None):
    """``columns`` of the legs are written once, for queries that read them
    more often than the thresholds do."""
    legs = tables.stored_legs(spark, sf_dir, columns) if columns else tables.legs(spark, sf_dir)
    return tg.label(fe.add_time_features(legs))


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def q_occupancy(spark, sf_dir):
    df = tg.occupancy_pct(tables.legs(spark, sf_dir))
    return df.select(*KEY, "occupancy_percentage")


def q_thresholds(spark, sf_dir):
    occ = tg.occupancy_pct(tables.legs(spark, sf_dir))
    return tg.all_thresholds(occ).select("method", r6("low"), r6("high"))


def q_tiers(spark, sf_dir):
    return labelled_legs(spark, sf_dir).select(*KEY, "occupancy_percentage", "comfort_tier",
                                               "comfort_tier_encoded")


def q_tiers_fixed(spark, sf_dir):
    df = tg.label(tables.legs(spark, sf_dir), method="fixed")
    return df.select(*KEY, "comfort_tier", "comfort_tier_encoded")


def q_tiers_adaptive(spark, sf_dir):
    df = tg.label(tables.legs(spark, sf_dir), method="adaptive")
    return df.select(*KEY, "comfort_tier", "comfort_tier_encoded")


def q_distribution(spark, sf_dir):
    return tg.tier_distribution(labelled_legs(spark, sf_dir)).select(
        "comfort_tier", "count", r6("percent"))


def q_crosstab(row):
    def run(spark, sf_dir):
        df = labelled_legs(spark, sf_dir)
        if row == "day_type":
            df = tg.weekend_label(df)
        return tg.crosstab_pct(df, row)
    return run


def q_counts(row):
    def run(spark, sf_dir):
        return tg.crosstab_counts(labelled_legs(spark, sf_dir), row)
    return run


def q_capacity_box(spark, sf_dir):
    legs = labelled_legs(spark, sf_dir, ["leg_departure_dt", "relevant_passengers_on_leg_departure", "vehicle_capacity"])
    return tg.box_stats(legs, "vehicle_capacity", "comfort_tier")


def q_occupancy_box(spark, sf_dir):
    b = tg.box_stats(tg.occupancy_pct(tables.legs(spark, sf_dir)), "occupancy_percentage")
    return b.select("n", r6("min"), r6("q1"), r6("median"), r6("q3"), r6("max"))


def q_histogram(spark, sf_dir):
    h = tg.histogram(tg.occupancy_pct(tables.legs(spark, sf_dir)))
    return h.select("bin", r6("bin_start"), r6("bin_end"), "count")


def q_describe(spark, sf_dir):
    d = pr.numeric_summary(tg.occupancy_pct(tables.legs(spark, sf_dir)), ["occupancy_percentage"])
    return d.select("column_name", "count", *[r6(c) for c in
                                              ("mean", "std", "min", "p25", "p50", "p75", "max")])


QUERIES = {
    "target_occupancy": q_occupancy,
    "target_thresholds": q_thresholds,
    "target_tiers": q_tiers,
    "target_tiers_fixed": q_tiers_fixed,
    "target_tiers_adaptive": q_tiers_adaptive,
    "target_distribution": q_distribution,
    "target_crosstab_coach": q_crosstab("coach_type"),
    "target_crosstab_period": q_crosstab("time_period"),
    "target_crosstab_weekend": q_crosstab("day_type"),
    "target_counts_hour": q_counts("hour_of_day"),
    "target_counts_coach": q_counts("coach_type"),
    "target_counts_period": q_counts("time_period"),
    "target_capacity_box": q_capacity_box,
    "target_occupancy_box": q_occupancy_box,
    "target_histogram": q_histogram,
    "target_describe": q_describe,
}

_OCC = f"occ AS (SELECT legs.*, {sq.pct('relevant_passengers_on_leg_departure', 'vehicle_capacity')} AS occupancy_percentage FROM legs)"
_KEYS = "messageId_leg_start, leg_departure_dt"


def _crosstab_sql(row_expr: str, row_name: str) -> str:
    return sq.labelled(
        f"c AS (SELECT {row_expr} AS {row_name}, "
        "COUNT(*) FILTER (WHERE comfort_tier = 'Busy') AS b, "
        "COUNT(*) FILTER (WHERE comfort_tier = 'Moderate') AS m, "
        "COUNT(*) FILTER (WHERE comfort_tier = 'Quiet') AS q FROM labe GROUP BY 1)",
        body=f"SELECT {row_name}, round_even(CAST(b AS DOUBLE) / (b + m + q) * 100.0, 1) AS Busy, "
             "round_even(CAST(m AS DOUBLE) / (b + m + q) * 100.0, 1) AS Moderate, "
             "round_even(CAST(q AS DOUBLE) / (b + m + q) * 100.0, 1) AS Quiet FROM c")


def _counts_sql(row: str) -> str:
    return sq.labelled(body=(
        f"SELECT {row}, COUNT(*) FILTER (WHERE comfort_tier = 'Busy') AS Busy, "
        "COUNT(*) FILTER (WHERE comfort_tier = 'Moderate') AS Moderate, "
        f"COUNT(*) FILTER (WHERE comfort_tier = 'Quiet') AS Quiet FROM labe GROUP BY {row}"))


def _tiers_with(low: str, high: str, src: str = "occ") -> str:
    return (f"SELECT {_KEYS}, CASE WHEN occupancy_percentage <= {low} THEN 'Quiet' "
            f"WHEN occupancy_percentage <= {high} THEN 'Moderate' ELSE 'Busy' END AS comfort_tier, "
            f"CAST(CASE WHEN occupancy_percentage <= {low} THEN 2 WHEN occupancy_percentage <= {high} "
            f"THEN 1 ELSE 0 END AS INTEGER) AS comfort_tier_encoded FROM {src}")


ORACLES = {
    "target_occupancy": sq.legs_only(_OCC, body=f"SELECT {_KEYS}, occupancy_percentage FROM occ"),
    "target_thresholds": sq.legs_only(_OCC, body=(
        "SELECT 'quantile' AS method, round(quantile_cont(occupancy_percentage, 0.33), 6) AS low, "
        "round(quantile_cont(occupancy_percentage, 0.67), 6) AS high FROM occ "
        "UNION ALL SELECT 'fixed', 40.0, 70.0 "
        "UNION ALL SELECT 'adaptive', round(avg(occupancy_percentage) - 0.5 * stddev_samp(occupancy_percentage), 6), "
        "round(avg(occupancy_percentage) + 0.5 * stddev_samp(occupancy_percentage), 6) FROM occ")),
    "target_tiers": sq.labelled(body=f"SELECT {_KEYS}, occupancy_percentage, comfort_tier, comfort_tier_encoded FROM labe"),
    "target_tiers_fixed": sq.legs_only(_OCC, body=_tiers_with("40.0", "70.0")),
    "target_tiers_adaptive": sq.legs_only(
        _OCC, "st AS (SELECT avg(occupancy_percentage) AS m, stddev_samp(occupancy_percentage) AS s FROM occ)",
        "o2 AS (SELECT occ.*, st.m - 0.5 * st.s AS lo, st.m + 0.5 * st.s AS hi FROM occ CROSS JOIN st)",
        body=_tiers_with("lo", "hi", "o2")),
    "target_distribution": sq.labelled(
        "t(comfort_tier) AS (VALUES ('Quiet'), ('Moderate'), ('Busy'))",
        body="SELECT t.comfort_tier, COUNT(labe.comfort_tier) AS count, "
             "round(CAST(COUNT(labe.comfort_tier) AS DOUBLE) / (SELECT COUNT(*) FROM labe) * 100.0, 6) AS percent "
             "FROM t LEFT JOIN labe ON labe.comfort_tier = t.comfort_tier GROUP BY t.comfort_tier"),
    "target_crosstab_coach": _crosstab_sql("coach_type", "coach_type"),
    "target_crosstab_period": _crosstab_sql("time_period", "time_period"),
    "target_crosstab_weekend": _crosstab_sql(
        "CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END", "day_type"),
    "target_counts_hour": _counts_sql("hour_of_day"),
    "target_counts_coach": _counts_sql("coach_type"),
    "target_counts_period": _counts_sql("time_period"),
    "target_capacity_box": sq.labelled(body=(
        "SELECT comfort_tier, COUNT(vehicle_capacity) AS n, min(vehicle_capacity) AS min, "
        "quantile_cont(vehicle_capacity, 0.25) AS q1, quantile_cont(vehicle_capacity, 0.5) AS median, "
        "quantile_cont(vehicle_capacity, 0.75) AS q3, max(vehicle_capacity) AS max FROM labe GROUP BY comfort_tier")),
    "target_occupancy_box": sq.legs_only(_OCC, body=(
        "SELECT COUNT(occupancy_percentage) AS n, round(min(occupancy_percentage), 6) AS min, "
        "round(quantile_cont(occupancy_percentage, 0.25), 6) AS q1, "
        "round(quantile_cont(occupancy_percentage, 0.5), 6) AS median, "
        "round(quantile_cont(occupancy_percentage, 0.75), 6) AS q3, "
        "round(max(occupancy_percentage), 6) AS max FROM occ")),
    "target_histogram": sq.legs_only(
        _OCC, "v AS (SELECT occupancy_percentage AS x FROM occ WHERE occupancy_percentage IS NOT NULL)",
        "mm AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 50.0 AS w FROM v)",
        "b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / w), 49) END AS INTEGER) AS bin, "
        "COUNT(*) AS count FROM v CROSS JOIN mm GROUP BY 1)",
        "g AS (SELECT CAST(i AS INTEGER) AS bin FROM range(50) r(i))",
        body="SELECT g.bin, round(mm.lo + g.bin * mm.w, 6) AS bin_start, "
             "round(mm.lo + (g.bin + 1) * mm.w, 6) AS bin_end, CAST(COALESCE(b.count, 0) AS BIGINT) AS count "
             "FROM g CROSS JOIN mm LEFT JOIN b ON b.bin = g.bin"),
    "target_describe": sq.legs_only(_OCC, body=(
        "SELECT 'occupancy_percentage' AS column_name, COUNT(occupancy_percentage) AS count, "
        "round(avg(occupancy_percentage), 6) AS mean, round(stddev_samp(occupancy_percentage), 6) AS std, "
        "round(min(occupancy_percentage), 6) AS min, round(quantile_cont(occupancy_percentage, 0.25), 6) AS p25, "
        "round(quantile_cont(occupancy_percentage, 0.5), 6) AS p50, "
        "round(quantile_cont(occupancy_percentage, 0.75), 6) AS p75, "
        "round(max(occupancy_percentage), 6) AS max FROM occ")),
}
