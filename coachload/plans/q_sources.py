"""Registered source queries (S1, S2) and their SQL oracles."""

from __future__ import annotations

from coachload.plans import sqlparts as sq
from coachload.sources import tables


def q_legs(spark, sf_dir):
    return tables.legs(spark, sf_dir)


def q_codes(spark, sf_dir):
    return tables.clean_codes(tables.tiplocs(spark, sf_dir))


QUERIES = {"legs_scan": q_legs, "station_codes": q_codes}

ORACLES = {
    "legs_scan": sq.legs_only(body="SELECT * FROM legs"),
    "station_codes": sq.with_ctes(sq.TIPLOCS_CTE, body=(
        "SELECT trim(tiploc_code) AS tiploc, description AS desc_name, "
        "tps_description AS tps_desc_name, crs_code AS crs FROM tiplocs "
        "WHERE tiploc_code IS NOT NULL AND trim(tiploc_code) <> ''")),
}
