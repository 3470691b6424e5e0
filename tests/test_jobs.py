"""The three end-to-end jobs: lookups -> train -> score."""

from pyspark.sql import functions as F

from coachload.operators import boosting as bo, lookups as lk, scoring as sc
from coachload.plans import jobs
from coachload.sources import requests as rq, tables
from tests.conftest import SF001


def test_lookup_train_score(spark, tmp_path):
    legs = tables.legs(spark, SF001)
    codes = tables.clean_codes(tables.tiplocs(spark, SF001))
    checks = jobs.build_lookup_job(legs, codes, str(tmp_path / "lookups"), "NATION_0", route_partitions=4)
    assert checks.where(~F.col("passed")).count() == 0
    info = jobs.train_job(legs, str(tmp_path / "bundle"),
                          estimator=bo.SoftmaxBoosting(rounds=2, max_depth=3, max_bins=32),
                          grid=[{"max_depth": 4, "rounds": 1}], folds=2)
    assert info["chosen"] in ("initial", "tuned") and 0.3 < info["test_accuracy_initial"] <= 1.0
    assert 0 < info["train_accuracy_initial"] <= 1 and len(info["history"]["train"]) == len(info["history"]["eval"])
    stations = lk.read_lookups(spark, str(tmp_path / "lookups"))["stations"]
    reqs = rq.fixture_requests(legs, stations)
    flat = jobs.score_job(spark, reqs, str(tmp_path / "lookups"), str(tmp_path / "bundle"),
                          str(tmp_path / "pred"))
    assert flat.where(F.col("status") == 200).count() > 0
    out = sc.read_predictions(spark, str(tmp_path / "pred"))
    assert out.count() == reqs.count()


def test_a_cleared_scratch_folder_is_noticed(spark, tmp_path):
    from coachload.session import still_there
    spark.range(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert still_there(df)
    (tmp_path / "t").rename(tmp_path / "elsewhere")
    assert not still_there(df)
