"""Calendar and time-of-day column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: period names, in bin order.
PERIODS = ["Night", "Early", "Morning", "Afternoon", "Evening", "Late"]
# Upper bounds of the training bins (right-closed, first bin includes 0).
PERIOD_EDGES = [6, 9, 12, 17, 20, 24]
# Time-of-day buckets of the historical averages: (name, first hour, last hour).
TIME_BUCKETS = [("morning_peak", 6, 9), ("midday", 10, 15),
                ("evening_peak", 16, 19), ("evening", 20, 23)]
TIME_BUCKET_OTHER = "night_early"


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def weekday_monday0(ts: Column) -> Column:
    """Monday=0 .. Sunday=6 (training features, serving requests)."""
    return F.weekday(ts)


def weekday_sunday0(ts: Column) -> Column:
    """Sunday=0 .. Saturday=6 (lookup tables, strftime %w)."""
    return F.dayofweek(ts) - 1


def is_weekend(dow_monday0: Column) -> Column:
    return (dow_monday0 >= 5).cast("int")


def is_peak_hour(hour: Column) -> Column:
    return (hour.between(7, 9) | hour.between(17, 19)).cast("int")


def time_period_train(hour: Column) -> Column:
    """Right-closed bins [0,6] (6,9] (9,12] (12,17] (17,20] (20,24]."""
    expr = None
    for name, edge in zip(PERIODS, PERIOD_EDGES):
        expr = F.when(hour <= edge, name) if expr is None else expr.when(hour <= edge, name)
    return expr


def time_period_serve(hour: Column) -> Column:
    """Left-closed bins [0,6) [6,9) [9,12) [12,17) [17,20), rest Late."""
    expr = None
    for name, edge in zip(PERIODS[:-1], PERIOD_EDGES[:-1]):
        expr = F.when(hour < edge, name) if expr is None else expr.when(hour < edge, name)
    return expr.otherwise(PERIODS[-1])


def time_bucket(hour: Column) -> Column:
    expr = None
    for name, lo, hi in TIME_BUCKETS:
        cond = hour.between(lo, hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(TIME_BUCKET_OTHER)


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")
