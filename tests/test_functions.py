"""Per-row helpers: names, time parts, coordinates (FIXTURES.md section 3)."""

import math

from pyspark.sql import functions as F

from coachload.functions import geo, names, time as tm


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalize_name(spark):
    got = col_values(spark, [None, "", " Kings  Cross ", "Leeds 12", "A & B", "St. John's", "!!"],
                     names.normalize_name)
    assert got == [None, None, "kings cross", "leeds", "a and b", "st johns", None]


def test_normalize_unicode_word_chars(spark):
    got = col_values(spark, ["Zürich Hbf", "São Paulo 3"], names.normalize_name)
    assert got == ["zürich hbf", "são paulo"]


def test_best_name(spark):
    df = spark.createDataFrame([
        ("kings cross", "kings cross"),          # equal: tps
        ("kings cross junction", "kings cross"),  # tps longer: tps
        ("leeds", "leeds long depot"),          # desc much longer: desc
        ("abc", None),                          # neither usable
        (None, "york"),                         # desc only
    ], "tps string, dsc string")
    got = [r[0] for r in df.select(names.best_name(F.col("tps"), F.col("dsc"))).collect()]
    assert got == ["kings cross", "kings cross junction", "leeds long depot", None, "york"]


def test_time_period_train(spark):
    hours = [0, 6, 7, 9, 10, 12, 13, 17, 18, 20, 21, 23]
    got = col_values(spark, hours, tm.time_period_train, "int")
    assert got == ["Night", "Night", "Early", "Early", "Morning", "Morning", "Afternoon",
                   "Afternoon", "Evening", "Evening", "Late", "Late"]


def test_time_period_serve(spark):
    got = col_values(spark, [0, 6, 9, 12, 17, 20], tm.time_period_serve, "int")
    assert got == ["Night", "Early", "Morning", "Afternoon", "Evening", "Late"]


def test_time_bucket(spark):
    got = col_values(spark, [5, 6, 9, 10, 15, 16, 19, 20, 23], tm.time_bucket, "int")
    assert got == ["night_early", "morning_peak", "morning_peak", "midday", "midday",
                   "evening_peak", "evening_peak", "evening", "evening"]


def test_weekday_numbering(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-14 10:00:00' AS ts")  # a Sunday
    r = df.select(tm.weekday_monday0(F.col("ts")), tm.weekday_sunday0(F.col("ts")),
                  tm.day_name(F.col("ts"))).first()
    assert tuple(r) == (6, 0, "Sunday")


def test_tolerant_location(spark):
    df = spark.createDataFrame([(0, ""), (1, "51.5"), (2, "x,y"), (3, "1,2,3"), (4, "50.5,-1.25")],
                               "i int, v string")
    lat, lon = geo.parse_location_tolerant(F.col("v"))
    got = [tuple(r) for r in df.orderBy("i").select(lat, lon).collect()]
    assert got == [(54.0, -2.0), (51.5, -2.0), (54.0, -2.0), (1.0, -2.0), (50.5, -1.25)]


def test_strict_location_defaults(spark):
    df = spark.createDataFrame([(0, ""), (1, "50.5,-1.25")], "i int, v string")
    lat, lon = geo.parse_location_strict(F.col("v"))
    got = [tuple(r) for r in df.orderBy("i").select(lat, lon).collect()]
    assert got == [(54.0, -2.0), (50.5, -1.25)]


def test_distances(spark):
    df = spark.sql("SELECT 51.5 AS a1, -0.12 AS o1, 53.48 AS a2, -2.24 AS o2")
    hv, pl = df.select(geo.haversine_km(*[F.col(c) for c in ("a1", "o1", "a2", "o2")]),
                       geo.planar_km(*[F.col(c) for c in ("a1", "o1", "a2", "o2")])).first()
    assert 255 < hv < 265
    assert math.isclose(pl, math.sqrt(1.98 ** 2 + 2.12 ** 2) * 111, rel_tol=1e-9)
