"""Registered queries against their DuckDB oracles on the smallest tables
(the driver runs the same comparison on sf0.01)."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as ent
from tests.conftest import SF001

FAST = ["legs_scan", "station_codes", "target_tiers", "target_distribution", "target_crosstab_weekend",
        "target_histogram", "profile_numeric_summary", "profile_top_values", "profile_quality",
        "features_matrix", "lookup_stations", "lookup_historical_averages", "lookup_validation",
        "scoring_service_match", "scoring_predictions", "model_split", "model_eval_report"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x.item() if hasattr(x, "item") else x) for x in rec)
           for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("nation", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    return c


def test_every_oracle_has_a_query():
    assert set(ent.oracle_sql()) <= set(ent.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    s = ent.queries()[name](spark, SF001).toPandas()
    d = con.execute(ent.oracle_sql()[name]).fetchdf()
    assert _rows(s) == _rows(d)


def test_entry(spark):
    df = ent.entry(spark)
    assert df.columns == ["comfort_tier", "count", "percent"] and df.count() == 3
