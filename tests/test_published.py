"""Publishing of table sets, and requests that cannot be read."""

import json

import pytest
from pyspark.sql import functions as F

from coachload.operators import scoring as sc
from coachload.sources import published as pb, requests as rq


def test_readers_see_a_whole_set(spark, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        pb.read_published(spark, path)

    def table(n):
        return spark.range(n).withColumn("of", F.lit(n))

    first = pb.publish({"a": table(1), "b": table(1)}, path)
    old = pb.read_published(spark, path)
    pb.publish({"a": table(2), "b": table(2)}, path)
    assert {n: d.first()["of"] for n, d in pb.read_published(spark, path).items()} == {"a": 2, "b": 2}
    assert {n: d.first()["of"] for n, d in old.items()} == {"a": 1, "b": 1}      # a reader of the version before goes on
    assert (tmp_path / "set" / "versions" / first).exists()

    broken = table(3).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception):
        pb.publish({"a": table(3), "b": broken}, path)
    assert {n: d.first()["of"] for n, d in pb.read_published(spark, path).items()} == {"a": 2, "b": 2}
    assert pb.current(spark, path)["number"] == 2
    with pytest.raises(KeyError):
        pb.read_published(spark, path, ["a", "c"])


def test_unreadable_requests_are_answered_one_by_one(spark, tmp_path):
    good = {"request_id": "r", "from_tiploc": "A", "to_tiploc": "B", "departure_datetimes": ["2024-01-15T08:30:00", "2024-01-15T09:30:00"]}
    (tmp_path / "in.json").write_text("\n".join([json.dumps(good), *rq.BROKEN_LINES, json.dumps({**good, "request_id": "s"})]))
    req = rq.read_requests(spark, str(tmp_path / "in.json"))
    rows = sc.explode_requests(req).collect()
    bad = [r for r in rows if r["status"] == 400]
    assert len(bad) == len(rq.BROKEN_LINES) and all(r["error"] == sc.BAD_REQUEST and r["pos"] is None for r in bad)
    assert len({r["request_id"] for r in bad}) == len(bad)
    assert sorted((r["request_id"], r["pos"]) for r in rows if r["status"] is None) == [("r", 0), ("r", 1), ("s", 0), ("s", 1)]


def test_bucketed_routes_are_matched_without_their_exchange(spark, tmp_path):
    """The route side of the service match: no exchange between its scan and its aggregate."""
    from coachload.operators import lookups as lk
    routes = spark.createDataFrame([(f"s{i % 7}", f"s{(i + 1) % 7}", i % 24, i % 7, f"h{i % 3}", "r", i % 11 + 1) for i in range(400)],
                                   "stationName_from string, stationName_to string, hour int, day_of_week int, headcode string, rsid string, frequency long")
    routes = routes.dropDuplicates(["stationName_from", "stationName_to", "hour", "day_of_week", "headcode"])
    path = str(tmp_path / "lookups")
    pb.publish({"service_routes_summary_mvp": routes}, path, buckets={"service_routes_summary_mvp": ("stationName_from", 4)})
    keys = spark.createDataFrame([(f"s{i % 8}", f"s{i % 5}", i % 24, i % 7) for i in range(100)], "from_station string, to_station string, req_hour int, req_dow int")
    want = sorted(map(str, sc.match_service(keys, routes).collect()))
    version = pb.current(spark, path)["version"]
    for fresh in (False, True):       # as written, and as another session finds it
        if fresh:
            spark.sql(f"DROP TABLE service_routes_summary_mvp_{version}")
        stored = pb.read_published(spark, path)["service_routes_summary_mvp"]
        assert sorted(map(str, sc.match_service(keys, stored).collect())) == want
        best = stored.groupBy("stationName_from", "stationName_to", "hour", "day_of_week").agg(F.min("headcode"))
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount: 4" in plan
    assert lk.REQUIRED_TABLES


def test_reports_gathered_while_a_table_is_written(spark, tmp_path):
    from coachload.operators import profile as pr
    df = spark.createDataFrame([(1, 2.0, "a", 0), (2, None, None, 1), (3, 7.0, "c", 1)], "x int, y double, s string, c int")
    df = df.withColumn("d", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("x"), F.lit(0), F.lit(0), F.lit(0)))
    scan = pr.ScanReports(df, target="x", date="d", label="c")
    scan.watch(df).write.parquet(str(tmp_path / "t"))
    got = scan.tables()
    assert got["columns"].collect() == pr.column_profile(df).collect()
    assert sorted(got["missing"].collect()) == sorted(pr.missing_report(df).collect())
    assert sorted(got["correlations"].collect()) == sorted(pr.correlations(df, "x").collect())
    assert got["dates"].first()[2] == pr.date_span(df, "d").first()[2] == 2
    assert [tuple(r) for r in got["labels"].collect()] == [(0, 1), (1, 2), (2, 0)]
