"""SQL fragments for the DuckDB oracle texts.

The oracle is an independent formulation of each query in plain SQL over
the same driver tables; these helpers only keep the repeated CASE texts in
one place.
"""

from coachload.sources.fixture_sql import LEGS_SQL, TIPLOCS_SQL

LEGS_CTE = f"legs AS ({LEGS_SQL})"
TIPLOCS_CTE = f"tiplocs AS ({TIPLOCS_SQL})"


def stored(*ctes: str) -> list[str]:
    """Each CTE is evaluated once, in the order given, so that the joins are
    planned from real sizes."""
    return [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def hour(ts: str) -> str:
    return f"CAST(EXTRACT(hour FROM {ts}) AS INTEGER)"


def dow_monday0(ts: str) -> str:
    return f"CAST(isodow({ts}) - 1 AS INTEGER)"


def dow_sunday0(ts: str) -> str:
    return f"CAST(dayofweek({ts}) AS INTEGER)"


def period_train(h: str) -> str:
    return (f"CASE WHEN {h} <= 6 THEN 'Night' WHEN {h} <= 9 THEN 'Early' "
            f"WHEN {h} <= 12 THEN 'Morning' WHEN {h} <= 17 THEN 'Afternoon' "
            f"WHEN {h} <= 20 THEN 'Evening' WHEN {h} <= 24 THEN 'Late' END")


def period_serve(h: str) -> str:
    return (f"CASE WHEN {h} < 6 THEN 'Night' WHEN {h} < 9 THEN 'Early' "
            f"WHEN {h} < 12 THEN 'Morning' WHEN {h} < 17 THEN 'Afternoon' "
            f"WHEN {h} < 20 THEN 'Evening' ELSE 'Late' END")


def time_bucket(h: str) -> str:
    return (f"CASE WHEN {h} BETWEEN 6 AND 9 THEN 'morning_peak' "
            f"WHEN {h} BETWEEN 10 AND 15 THEN 'midday' "
            f"WHEN {h} BETWEEN 16 AND 19 THEN 'evening_peak' "
            f"WHEN {h} BETWEEN 20 AND 23 THEN 'evening' ELSE 'night_early' END")


def pct(num: str, den: str) -> str:
    return f"({num}) / NULLIF({den}, 0) * 100.0"


def normalize(col: str) -> str:
    s = f"lower({col})"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '\\s+\\d+$', '')"
    s = f"replace({s}, '&', 'and')"
    s = f"regexp_replace({s}, '[^\\w\\s]', '', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"NULLIF({s}, '')"


# Time features (training form) over the legs CTE.
TIME_FEATURES_CTE = f"""tf AS (
  SELECT legs.*, {hour('leg_departure_dt')} AS hour_of_day,
         {dow_monday0('leg_departure_dt')} AS day_of_week,
         CAST(EXTRACT(month FROM leg_departure_dt) AS INTEGER) AS month,
         CAST(EXTRACT(day FROM leg_departure_dt) AS INTEGER) AS day_of_month,
         CAST(CASE WHEN {dow_monday0('leg_departure_dt')} >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
         {period_train(hour('leg_departure_dt'))} AS time_period,
         CAST(CASE WHEN {hour('leg_departure_dt')} BETWEEN 7 AND 9
                     OR {hour('leg_departure_dt')} BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS INTEGER) AS is_peak_hour
  FROM legs)"""

# Occupancy, quantile thresholds and tiers over tf.
LABELLED_CTES = [
    f"occ AS (SELECT tf.*, {pct('relevant_passengers_on_leg_departure', 'vehicle_capacity')} AS occupancy_percentage FROM tf)",
    "thr AS (SELECT quantile_cont(occupancy_percentage, 0.33) AS low, "
    "quantile_cont(occupancy_percentage, 0.67) AS high FROM occ)",
    "lab AS (SELECT occ.*, CASE WHEN occupancy_percentage <= thr.low THEN 'Quiet' "
    "WHEN occupancy_percentage <= thr.high THEN 'Moderate' ELSE 'Busy' END AS comfort_tier "
    "FROM occ CROSS JOIN thr)",
    "labe AS (SELECT lab.*, CAST(CASE comfort_tier WHEN 'Busy' THEN 0 WHEN 'Moderate' THEN 1 "
    "ELSE 2 END AS INTEGER) AS comfort_tier_encoded FROM lab)",
]


def labelled(*more: str, body: str) -> str:
    return with_ctes(LEGS_CTE, TIME_FEATURES_CTE, *LABELLED_CTES, *more, body=body)


def legs_only(*more: str, body: str) -> str:
    return with_ctes(LEGS_CTE, *more, body=body)
