"""Station dimension and aggregates on the driver tables."""

from pyspark.sql import functions as F

from coachload.operators import lookups as lk
from coachload.sources import tables
from tests.conftest import SF001


def test_station_matching_sources(spark):
    legs = tables.legs(spark, SF001)
    codes = tables.clean_codes(tables.tiplocs(spark, SF001))
    st = lk.build_stations(legs, codes, keep_source=True)
    rows = {r["station_name"]: r for r in st.collect()}
    # nation k: k%4==0 primary, 1 description fallback, 2 tps fallback, 3 none;
    # NATION_24 has an empty location and is not a station
    for name, r in rows.items():
        k = int(name.split("_")[1])
        assert r["match_source"] == {0: "primary", 1: "description", 2: "tps", 3: None}[k % 4]
        assert (r["tiploc"] is None) == (k % 4 == 3)
    assert "NATION_24" not in rows
    assert len(rows) == st.select("station_name").distinct().count()


def test_missing_codes_source_is_empty(spark):
    codes = tables.read_codes(spark, "/nonexistent/codes.parquet")
    assert codes.count() == 0 and codes.columns == ["tiploc", "desc_name", "tps_desc_name", "crs"]


def test_route_frequencies_sum_to_rows(spark):
    legs = tables.legs(spark, SF001)
    total = lk.service_routes(legs).agg(F.sum("frequency")).first()[0]
    assert total == legs.count()


def test_routes_independent_of_partitioning(spark):
    legs = tables.legs(spark, SF001)
    a = lk.service_routes(legs.repartition(3)).collect()
    b = lk.service_routes(legs.repartition(11, "rsid")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_validation_and_write(spark, tmp_path):
    legs = tables.legs(spark, SF001)
    codes = tables.clean_codes(tables.tiplocs(spark, SF001))
    t = lk.build_lookups(legs, codes)
    checks = {r["check"]: (r["passed"], r["value"]) for r in lk.validate_lookups(t, "NATION_0").collect()}
    assert checks["tables_present"][0] and checks["code_round_trip"] == (True, "T1000->NATION_0")
    lk.write_lookups(t, str(tmp_path), route_partitions=4)
    back = lk.read_lookups(spark, str(tmp_path))
    assert back["service_routes_summary_mvp"].count() == t["service_routes_summary_mvp"].count()
    assert back["metadata"].first()["total_source_records_in_legs"] == legs.count()
