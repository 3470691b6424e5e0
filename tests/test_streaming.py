"""Streaming scoring of request files gives the batch result."""

import json

from pyspark.sql import functions as F

from coachload.operators import features as fe, lookups as lk, model as md, scoring as sc, target as tg
from coachload.plans.q_scoring import SERVE_FEATURES
from coachload.sources import requests as rq, tables
from coachload.streaming.scoring_stream import start_scoring
from tests.conftest import SF001


def test_stream_matches_batch(spark, tmp_path):
    legs = tables.legs(spark, SF001)
    codes = tables.clean_codes(tables.tiplocs(spark, SF001))
    lookups = lk.build_lookups(legs, codes)
    labels = fe.fit_labels(fe.add_time_features(legs))
    model = md.ThresholdModel(tg.thresholds(tg.occupancy_pct(legs)))
    reqs = rq.fixture_requests(legs, lookups["stations"]).orderBy("request_id").limit(20)
    rows = [r.asDict(recursive=True) for r in reqs.collect()]
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        with open(src / f"part{i}.json", "w") as fh:
            for r in rows[i::2]:
                fh.write(json.dumps(r) + "\n")
    q = start_scoring(spark, str(src), lookups, model, labels, SERVE_FEATURES, str(tmp_path / "out"),
                      checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    want = sc.score(spark.createDataFrame(rows, rq.REQUEST_SCHEMA), lookups, model, labels, SERVE_FEATURES)
    cols = sorted(c for c in want.columns if c != sc.ROW_ID)
    assert got.count() == want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert got.where(F.col("status") == 200).count() > 0
