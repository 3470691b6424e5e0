"""Tier thresholds, assignment and reports."""

import pytest
from pyspark.sql import functions as F

from coachload.operators import target as tg


@pytest.fixture()
def occ(spark):
    rows = [(float(x), 100.0) for x in range(1, 101)] + [(5.0, 0.0)]  # last: zero capacity
    df = spark.createDataFrame(rows, "relevant_passengers_on_leg_departure double, vehicle_capacity double")
    return tg.occupancy_pct(df)


def test_zero_capacity_is_null_and_busy(occ):
    lab = tg.assign_tier(occ, tg.thresholds(occ, "fixed"))
    r = lab.where(F.col("vehicle_capacity") == 0).first()
    assert r["occupancy_percentage"] is None and r["comfort_tier"] == "Busy"


def test_quantile_thresholds_linear(occ):
    t = tg.thresholds(occ).first()
    assert t["low"] == pytest.approx(1 + 0.33 * 99)
    assert t["high"] == pytest.approx(1 + 0.67 * 99)


def test_adaptive_thresholds(occ):
    t = tg.thresholds(occ, "adaptive").first()
    vals = list(range(1, 101))
    m = sum(vals) / 100
    s = (sum((v - m) ** 2 for v in vals) / 99) ** 0.5
    assert t["low"] == pytest.approx(m - 0.5 * s) and t["high"] == pytest.approx(m + 0.5 * s)


def test_unknown_method(occ):
    with pytest.raises(ValueError):
        tg.thresholds(occ, "median")


def test_distribution_lists_all_tiers(spark):
    df = spark.createDataFrame([("Quiet",), ("Quiet",)], "comfort_tier string")
    got = {r["comfort_tier"]: (r["count"], r["percent"]) for r in tg.tier_distribution(df).collect()}
    assert got == {"Quiet": (2, 100.0), "Moderate": (0, 0.0), "Busy": (0, 0.0)}


def test_tier_counts_sum_to_rows(occ):
    lab = tg.encode_tier(tg.assign_tier(occ, tg.thresholds(occ)))
    d = tg.tier_distribution(lab).collect()
    assert sum(r["count"] for r in d) == occ.count()
    codes = {r["comfort_tier"]: r["comfort_tier_encoded"] for r in lab.select(
        "comfort_tier", "comfort_tier_encoded").distinct().collect()}
    assert codes == {"Busy": 0, "Moderate": 1, "Quiet": 2}


def test_crosstab_half_even(spark):
    # 1 of 8 = 12.5 % -> bround to 12.5; 3 of 8 = 37.5 %
    rows = [("A", "Busy")] + [("A", "Quiet")] * 3 + [("A", "Moderate")] * 4
    df = spark.createDataFrame(rows, "coach_type string, comfort_tier string")
    r = tg.crosstab_pct(df, "coach_type").first()
    assert (r["Busy"], r["Moderate"], r["Quiet"]) == (12.5, 50.0, 37.5)


def test_histogram_all_bins(occ):
    h = tg.histogram(occ, bins=10).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 100
    assert h[-1]["count"] == 10   # max value falls in the last (closed) bin


def test_duplicate_count_exact(spark):
    from coachload.operators import profile as pr
    rows = [(1, "a", None)] * 3 + [(1, None, "a"), (2, "b", "c"), (2, "b", "c"), (3, None, None)]
    df = spark.createDataFrame(rows, "x int, y string, z string")
    assert pr.duplicate_count(df).first()[0] == 3
