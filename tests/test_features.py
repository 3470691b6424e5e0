"""Label encoding (fit / unseen -> 0), alignment, scaling, request IO."""

import json

import pytest
from pyspark.sql import functions as F

from coachload.operators import features as fe, model as md, scoring as sc
from coachload.sources import requests as rq


def test_label_codes_sorted_and_unknown(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x")], "coach_type string, headcode string")
    labels = fe.fit_labels(df, ["coach_type", "headcode"])
    got = {(r["column"], r["value"]): r["code"] for r in labels.collect()}
    assert got == {("coach_type", "a"): 0, ("coach_type", "b"): 1, ("coach_type", "c"): 2,
                   ("headcode", "x"): 0, ("headcode", "y"): 1}
    new = spark.createDataFrame([("c", "z")], "coach_type string, headcode string")
    train = fe.apply_labels(new, labels, ["coach_type", "headcode"]).first()
    serve = fe.apply_labels(new, labels, ["coach_type", "headcode"], unknown=0).first()
    assert (train["coach_type_encoded"], train["headcode_encoded"]) == (2, None)
    assert (serve["coach_type_encoded"], serve["headcode_encoded"]) == (2, 0)


def test_align_adds_missing_as_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0)], "a double, b double, extra double")
    out = fe.align(df, ["b", "c", "a"])
    assert out.columns == ["b", "c", "a"] and tuple(out.first()) == (2.0, 0, 1.0)


def test_selection_groups(spark):
    df = spark.createDataFrame([(1, 2.0, 0)], "hour_of_day int, vehicle_capacity double, comfort_tier_encoded int")
    x, available, missing = fe.select_features(df)
    assert available == ["hour_of_day", "vehicle_capacity"] and len(missing) == 35
    assert x.columns == ["comfort_tier_encoded", "hour_of_day", "vehicle_capacity"]
    tab = fe.feature_group_table(spark, df.columns)
    assert tab.where("available").count() == 2 and tab.count() == 37


def test_selective_scaling(spark):
    rows = [(float(i), float(i * 1000)) for i in range(10)]
    df = spark.createDataFrame(rows, "small double, big double")
    plan = md.scaling_plan(md.feature_ranges(df, ["small", "big"]))
    flags = {r["feature"]: r["scaled"] for r in plan.collect()}
    assert flags == {"small": False, "big": True}
    out = md.apply_scaling(df, plan)
    st = out.agg(F.avg("big"), F.stddev_pop("big"), F.max("small")).first()
    assert st[0] == pytest.approx(0.0, abs=1e-12) and st[1] == pytest.approx(1.0) and st[2] == 9.0


def test_read_requests_and_write_predictions(spark, tmp_path):
    src = tmp_path / "req.json"
    src.write_text("\n".join(json.dumps(r) for r in [
        {"from_tiploc": "A", "to_tiploc": "B", "departure_datetimes": ["2024-01-15T08:30:00"]},
        {"request_id": "r2", "from_tiploc": "A", "to_tiploc": None, "departure_datetimes": []}]))
    req = rq.read_requests(spark, str(src))
    assert req.where(F.col("request_id").isNull()).count() == 0 and req.count() == 2
    flat = spark.createDataFrame(
        [("r1", 1, "A", "B", "a", "b", "2024-01-15T09:00:00", "H", "R", "b", "false", "false", "false", 200,
          None, "Quiet", 0.8, 3, "Busy", 0.8, 1),
         ("r1", 0, "A", "B", "a", "b", "2024-01-15T08:00:00", "H", "R", "b", "false", "false", "false", 200,
          None, "Quiet", 0.8, 3, "Quiet", 0.8, 3)],
        "request_id string, pos int, from_tiploc string, to_tiploc string, from_station string, to_station string, "
        "departure_datetime string, headcode string, rsid string, next_stop string, fallback_used string, "
        "time_fallback string, route_fallback string, status int, error string, standard_tier string, "
        "standard_confidence double, standard_score int, first_tier string, first_confidence double, "
        "first_score int")
    sc.write_predictions(flat, str(tmp_path / "out"))
    back = sc.read_predictions(spark, str(tmp_path / "out")).first()
    assert [p["pos"] for p in back["predictions"]] == [0, 1]
    assert back["predictions"][1]["first_class"]["comfort_tier"] == "Busy"


def test_label_codes_are_ranked_over_partitions(spark):
    import random
    r = random.Random(1)
    values = sorted({f"v{r.randrange(10**6)}é"[: r.randint(2, 7)] for _ in range(4000)}, key=str.encode)
    rows = [(v, "abc"[i % 3]) for i, v in enumerate(values)] + [(None, "a"), (values[0], None)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "headcode string, coach_type string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = fe.fit_labels(df, ["headcode", "coach_type"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {(x["column"], x["value"]): x["code"] for x in labels.collect()}
    assert got == {**{("headcode", v): i for i, v in enumerate(values)}, **{("coach_type", v): i for i, v in enumerate("abc")}}
    # a column beyond MAP_VALUES is joined, a short one looked up; both give the same codes
    out = fe.apply_labels(df, labels, ["headcode", "coach_type"], unknown=0).collect()
    assert all(x["headcode_encoded"] == got.get(("headcode", x["headcode"]), 0) for x in out)
    assert all(x["coach_type_encoded"] == got.get(("coach_type", x["coach_type"]), 0) for x in out) and len(out) == len(rows)
