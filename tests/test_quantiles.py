"""Order statistics by sketch brackets, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coachload.operators import quantiles as qu

PROBS = [0.0, 0.1, 0.25, 0.33, 0.5, 0.67, 0.999, 1.0]


def frame(spark, columns):
    rows = [(k, float(v)) for k, vs in columns.items() for v in vs] + [("none", None)]
    return spark.createDataFrame(rows, "key string, v double").repartition(5)


@pytest.fixture(scope="module")
def columns():
    r = np.random.default_rng(4)
    return {"continuous": r.normal(size=30_000) ** 3, "steps": r.integers(0, 40, 20_000), "one": np.array([3.0]), "two": np.array([1.0, 5.0]),
            "hot": np.r_[np.full(20_000, 7.0), r.normal(size=5_000)], "signed": np.array([-0.0, 0.0, -1.0, 1.0])}


@pytest.mark.parametrize("local", [1 << 16, 0])
def test_quantiles_of_several_keys(spark, columns, monkeypatch, local):
    monkeypatch.setattr(qu, "LOCAL_VALUES", local)
    got = {r["key"]: r["q"] for r in qu.exact_quantiles(frame(spark, columns), PROBS).collect()}
    assert set(got) == set(columns)
    for k, v in columns.items():
        assert got[k] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12, abs=1e-12)


def test_only_the_brackets_are_shuffled(spark, columns, monkeypatch):
    """Of a continuous column a few in a thousand values go to the next step."""
    values = frame(spark, {"continuous": columns["continuous"]})
    monkeypatch.setattr(qu, "LOCAL_VALUES", 0)
    seen, own = [], qu.at_ranks
    try:
        qu.at_ranks = lambda counts, ranks: seen.append(counts.count()) or own(counts, ranks)
        qu.exact_quantiles(values, [0.25, 0.5, 0.75]).collect()
    finally:
        qu.at_ranks = own
    assert seen[0] < 0.02 * 30_000


def test_a_missed_bracket_is_made_good(spark, columns, monkeypatch):
    """Brackets beside their ranks: the counts tell, and all values are counted."""
    own = qu._brackets
    monkeypatch.setattr(qu, "_brackets", lambda v, w: {k: (n, r, [[x + 1.5, y + 1.5] for x, y in b]) for k, (n, r, b) in own(v, w).items()})
    got = {r["key"]: r["q"] for r in qu.exact_quantiles(frame(spark, columns), PROBS).collect()}
    for k, v in columns.items():
        assert got[k] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12, abs=1e-12)


def test_not_a_number_is_the_greatest(spark):
    got = qu.column_quantiles(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("nan"),), (None,)], "x double"), "x", [0.0, 1 / 3, 1.0])
    q = got.first()["q"]
    assert q[:2] == [1.0, 2.0] and math.isnan(q[2])
    assert qu.column_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).first()["q"] is None
    assert qu.column_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).first()["q"] is None


def test_ranks_given_as_rows(spark):
    counts = spark.createDataFrame([("a", float(i), 1 + i % 3) for i in range(100)], "key string, v double, n long")
    wanted = spark.createDataFrame([("a", [(0, 0), (1, 57), (2, 198)])], "key string, ranks array<struct<i:int,rank:long>>")
    flat = [float(i) for i in range(100) for _ in range(1 + i % 3)]
    got = {r["i"]: r["v"] for r in qu.at_ranks(counts, wanted).collect()}
    assert got == {0: flat[0], 1: flat[57], 2: flat[198]}
    assert qu.at_ranks(counts, lambda n: F.array(F.lit(57))).first()["v"] == flat[57]
