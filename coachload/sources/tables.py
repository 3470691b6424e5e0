"""Scans of the input tables (S1, S2) and the derived fixture views.

The driver ships TPC-H-like tables; the journey-leg fact table and the
station-code table are views over them (FIXTURES.md section 2).  They are
built with column expressions so Catalyst prunes every column a query does
not read down to the parquet scan, and the two joins with the 25-row nation
table are planned as broadcast joins from the file statistics.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

LEGS_SCHEMA = T.StructType([
    T.StructField("coach_type", T.StringType()),
    T.StructField("driverId", T.StringType()),
    T.StructField("headcode", T.StringType()),
    T.StructField("leg_departure_dt", T.TimestampNTZType()),
    T.StructField("messageId_leg_start", T.StringType()),
    T.StructField("next_station_departure_dt", T.TimestampNTZType()),
    T.StructField("offUnitPassenger_at_from_station", T.LongType()),
    T.StructField("onUnitPassenger_at_from_station", T.LongType()),
    T.StructField("relevant_passengers_on_leg_departure", T.DoubleType()),
    T.StructField("rsid", T.StringType()),
    T.StructField("stationLocation_from", T.StringType()),
    T.StructField("stationLocation_to", T.StringType()),
    T.StructField("stationName_from", T.StringType()),
    T.StructField("stationName_to", T.StringType()),
    T.StructField("totalUnitPassenger_at_leg_departure", T.LongType()),
    T.StructField("unitId", T.StringType()),
    T.StructField("vehicle_capacity", T.DoubleType()),
    T.StructField("vehicle_pax_alighted_first_at_from", T.DoubleType()),
    T.StructField("vehicle_pax_alighted_std_at_from", T.DoubleType()),
    T.StructField("vehicle_pax_boarded_first_at_from", T.DoubleType()),
    T.StructField("vehicle_pax_boarded_std_at_from", T.DoubleType()),
    T.StructField("vehicle_pax_on_arrival_first_at_from", T.DoubleType()),
    T.StructField("vehicle_pax_on_arrival_std_at_from", T.DoubleType()),
    T.StructField("vehicleNo", T.StringType()),
])

CODES_SCHEMA = T.StructType([
    T.StructField("tiploc_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tps_description", T.StringType()),
    T.StructField("crs_code", T.StringType()),
])

# Columns that identify a leg row; (messageId, departure) is unique at every
# driver scale except one collision at sf0.001, so nothing relies on it.
LEG_KEY = ["messageId_leg_start", "leg_departure_dt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_legs(spark: SparkSession, path: str) -> DataFrame:
    """S1 for a stored legs dataset: fixed schema, checked once at the scan."""
    return spark.read.schema(LEGS_SCHEMA).parquet(path)


def _txt(c: Column) -> Column:
    return c.cast("string")


def _station_dim(nation: DataFrame) -> DataFrame:
    nk = F.col("n_nationkey")
    loc = F.when(nk == 24, F.lit("")).otherwise(F.concat(
        _txt(50 + nk % 9), F.lit("."), _txt(1000 + (nk * 137) % 9000), F.lit(",-"),
        _txt(nk % 5), F.lit("."), _txt(1000 + (nk * 251) % 9000)))
    return nation.select(nk.alias("nk"), F.col("n_name").alias("nm"), loc.alias("loc"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journey-leg fact table derived from lineitem, orders and nation."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = li.join(od, li["l_orderkey"] == od["o_orderkey"]).select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_shipdate").alias("sd"), F.col("l_quantity").cast("bigint").alias("q"),
        F.col("o_custkey").alias("ck"),
        (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17
         + F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("h"))
    h = F.col("h")
    cap = (F.when(h % 3 == 0, 40 + h % 41).when(h % 3 == 1, 60 + h % 61)
           .otherwise(80 + h % 71))
    ct = (F.when(h % 3 == 0, "First Class").when(h % 3 == 1, "Standard")
          .otherwise("Mixed"))
    dep = F.col("sd") + F.make_dt_interval(
        hours=(5 + h % 19).cast("int"), mins=((h % 4) * 15).cast("int"))
    v = k.select("*", ct.alias("ct"), cap.alias("cap"), (F.col("sk") % 25).alias("fk"),
                 ((F.col("sk") % 25 + 1 + F.col("ck") % 24) % 25).alias("tk"),
                 dep.alias("dep"))

    def floor_div(num: Column, den: int) -> Column:
        return F.floor(num / F.lit(float(den))).cast("bigint")

    std_ct = F.col("ct") == "Standard"
    cap_c = F.col("cap")
    a = v.select("*",
                 floor_div(cap_c * (20 + F.col("q") + h % 23), 100).alias("a_std"),
                 F.when(std_ct, F.lit(0).cast("bigint"))
                 .otherwise(floor_div(cap_c * (20 + F.col("q") + h % 23), 500)).alias("a_fst"))
    f = a.select("*",
                 floor_div(F.col("a_std") * (10 + h % 31), 100).alias("al_std"),
                 floor_div(F.col("a_fst") * (10 + h % 31), 100).alias("al_fst"),
                 floor_div(cap_c * (5 + h % 26), 100).alias("bo_std"),
                 F.when(std_ct, F.lit(0).cast("bigint"))
                 .otherwise(floor_div(cap_c * (5 + h % 26), 500)).alias("bo_fst"),
                 (5 + h % 21).alias("on_u"), (3 + h % 18).alias("off_u"))
    dim = _station_dim(table(spark, sf_dir, "nation"))
    sf_ = dim.select(F.col("nk").alias("f_nk"), F.col("nm").alias("f_nm"), F.col("loc").alias("f_loc"))
    st_ = dim.select(F.col("nk").alias("t_nk"), F.col("nm").alias("t_nm"), F.col("loc").alias("t_loc"))
    j = f.join(sf_, F.col("f_nk") == F.col("fk")).join(st_, F.col("t_nk") == F.col("tk"))
    dbl = lambda c: F.col(c).cast("double")
    return j.select(
        F.col("ct").alias("coach_type"),
        F.concat(F.lit("DR"), _txt(1000 + h % 9000)).alias("driverId"),
        F.concat(F.lit("2X0"), _txt(F.col("pk") % 8)).alias("headcode"),
        F.col("dep").alias("leg_departure_dt"),
        F.concat_ws("-", _txt(F.col("ok")), _txt(F.col("ln")), _txt(F.col("pk")),
                    _txt(F.col("sk"))).alias("messageId_leg_start"),
        (F.col("dep") + F.make_dt_interval(mins=(20 + h % 41).cast("int")))
        .alias("next_station_departure_dt"),
        F.col("off_u").alias("offUnitPassenger_at_from_station"),
        F.col("on_u").alias("onUnitPassenger_at_from_station"),
        (F.col("a_std") + F.col("a_fst") - F.col("al_std") - F.col("al_fst")
         + F.col("bo_std") + F.col("bo_fst")).cast("double")
        .alias("relevant_passengers_on_leg_departure"),
        F.concat(F.lit("RS"), _txt(100001 + F.col("sk") % 6)).alias("rsid"),
        F.col("f_loc").alias("stationLocation_from"), F.col("t_loc").alias("stationLocation_to"),
        F.col("f_nm").alias("stationName_from"), F.col("t_nm").alias("stationName_to"),
        (F.col("a_std") + F.col("a_fst") + F.col("on_u") - F.col("off_u"))
        .alias("totalUnitPassenger_at_leg_departure"),
        F.concat(F.lit("UNIT"), _txt(100 + h % 900)).alias("unitId"),
        dbl("cap").alias("vehicle_capacity"),
        dbl("al_fst").alias("vehicle_pax_alighted_first_at_from"),
        dbl("al_std").alias("vehicle_pax_alighted_std_at_from"),
        dbl("bo_fst").alias("vehicle_pax_boarded_first_at_from"),
        dbl("bo_std").alias("vehicle_pax_boarded_std_at_from"),
        dbl("a_fst").alias("vehicle_pax_on_arrival_first_at_from"),
        dbl("a_std").alias("vehicle_pax_on_arrival_std_at_from"),
        F.concat(F.lit("VEH"), _txt(10000 + h % 90000)).alias("vehicleNo"),
    )


def stored_legs(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """``columns`` of the derived legs, written once for queries that read
    them several times; the stand-in for a stored legs table, which a
    deployment scans with ``read_legs``."""
    from coachload.session import materialize
    return materialize(legs(spark, sf_dir).select(*columns), "legs")


def tiplocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station-code table derived from nation (one branch per name case)."""
    nk = F.col("n_nationkey")
    nm = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("T"), _txt(1000 + nk)).alias("tiploc_code"),
        F.when(nk % 4 == 2, F.concat(nm, F.lit(" Long Depot")))
        .when(nk % 4 == 3, F.lit(None).cast("string")).otherwise(nm).alias("description"),
        F.when(nk % 4 == 1, F.concat(nm, F.lit(" Junction")))
        .when(nk % 4 == 3, F.lit("abc")).otherwise(nm).alias("tps_description"),
        F.when(nk % 2 == 0, F.concat(F.lit("C"), _txt(10 + nk))).alias("crs_code"),
    )


def read_codes(spark: SparkSession, path: str | None, fmt: str = "parquet",
               options: dict | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Station codes with trimmed, non-blank codes.

    ``columns`` maps the names of ``CODES_SCHEMA`` to the source's own names.
    A source that is missing, lacks a column or breaks while it is read gives
    an empty table with the same schema and a warning, so the lookup build
    still runs (stations without codes).  To know that, the source is read
    here, once, into the shared folder.
    """
    from coachload.session import materialize
    own = {f.name: (columns or {}).get(f.name, f.name) for f in CODES_SCHEMA}
    schema = T.StructType([T.StructField(own[f.name], f.dataType) for f in CODES_SCHEMA])
    if path:
        try:
            raw = spark.read.format(fmt).options(**(options or {})).schema(schema).load(path)
            return materialize(clean_codes(raw.select(*[F.col(f"`{own[n]}`").alias(n) for n in own])), "codes")
        except Exception as exc:  # noqa: BLE001
            log.warning("station codes unavailable at %s: %s", path, exc)
    log.warning("proceeding without station codes")
    return clean_codes(spark.createDataFrame([], CODES_SCHEMA))


def clean_codes(raw: DataFrame) -> DataFrame:
    code = F.trim(F.col("tiploc_code"))
    return (raw.where(F.col("tiploc_code").isNotNull() & (code != ""))
            .select(code.alias("tiploc"), F.col("description").alias("desc_name"),
                    F.col("tps_description").alias("tps_desc_name"),
                    F.col("crs_code").alias("crs")))
