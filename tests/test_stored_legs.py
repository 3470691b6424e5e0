"""Queries that read the legs several times derive them once."""

import pytest
from pyspark.sql import functions as F

from coachload.operators import model as md
from coachload.plans import q_features, q_lookups, q_model, q_profile, q_scoring, q_target
from tests.conftest import SF001


@pytest.mark.parametrize("query", [q_target.q_capacity_box, q_features.q_sample, q_profile.q_quality])
def test_result_does_not_join_the_legs_again(spark, query):
    assert "lineitem" not in query(spark, SF001)._jdf.queryExecution().toString()


def test_stored_hash_gives_the_same_split(spark):
    rows = [(str(i % 40), "x", i % 3, i // 40) for i in range(400)] + [("7", "x", 1, 0)] * 200 + [(None, None, 2, None)] * 3
    df = spark.createDataFrame(rows, "k string, d string, c int, v int")
    held = df.withColumn("h", md.split_hash(["k", "d"]))
    own = md.stratified_split(df, "c", ["k", "d"]).collect()
    assert sorted(map(str, own)) == sorted(map(str, md.stratified_split(held, "c", ["k", "d"], hashed="h").collect()))


def test_split_reads_the_stored_hash(spark):
    split = q_model.Ctx(spark, SF001).split
    assert q_model.HASHED not in split.columns
    assert "md5" not in split._jdf.queryExecution().optimizedPlan().toString()
    assert split.where(F.col("split") == "test").count() > 0


def test_lookup_set_derives_the_legs_and_its_tables_once(spark):
    tables = q_lookups.lookup_set(spark, SF001)
    for name, df in tables.items():
        assert "lineitem" not in df._jdf.queryExecution().toString(), name
    assert "Aggregate [headcode" not in tables["metadata"]._jdf.queryExecution().optimizedPlan().toString()
    for name, column in (("service_routes_summary_mvp", "service_patterns_count"), ("historical_averages", "historical_patterns_count"),
                         ("stations", "stations_count"), ("coach_info", "coach_types_count")):
        assert tables["metadata"].first()[column] == tables[name].count()


def test_scoring_stores_no_column_that_only_the_probe_reads():
    assert "next_station_departure_dt" not in q_scoring.SCORING_LEGS
    assert "next_station_departure_dt" in q_scoring.MATCH_LEGS
