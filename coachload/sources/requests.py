"""Scoring requests (S6): readers and the fixture derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coachload.functions import time as tm

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("from_tiploc", T.StringType()),
    T.StructField("to_tiploc", T.StringType()),
    T.StructField("departure_datetimes", T.ArrayType(T.StringType())),
])

# Of JSON lines: the text of one that is no request is kept.
LINE_SCHEMA = T.StructType([*REQUEST_SCHEMA, T.StructField("malformed", T.StringType())])
LINE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}

# Fixed values from the reference's own batch test (three times of one day).
FIXTURE_DATETIMES = ["2024-01-15T08:30:00", "2024-01-15T12:00:00", "2024-01-15T17:30:00"]
BAD_DATETIME = "15/01/2024 08:30"
UNKNOWN_CODE = "NOSUCHCODE"
# Lines that are no requests, beside those of the fixture: cut off, not JSON, a
# list, a field of another type.
BROKEN_LINES = ['{"request_id": "cut-off", "from_tip', "not json", "[1, 2]", '{"request_id": "text-for-list", "departure_datetimes": "2024-01-15"}']
# A station that only the fixture's lookups hold, without any route from it.
NO_SERVICE_STATION, NO_SERVICE_CODE = "ARRIVALS ONLY", "TEND"
# Requests on the smallest valid pair: id, row, origin, destination, times;
# "f" and "t" are the pair's codes.
SPECIAL = [
    ("invalid-datetime", "invalid-datetime", "f", "t", [FIXTURE_DATETIMES[0], BAD_DATETIME]),
    ("unknown-code", "unknown-code", "f", UNKNOWN_CODE, FIXTURE_DATETIMES),
    ("missing-field", "missing-field", "f", None, FIXTURE_DATETIMES),
    ("missing-list", "missing-list", "f", "t", None),
    ("null-item", "null-item", "f", "t", [FIXTURE_DATETIMES[0], None]),
    ("empty-list", "empty-list", "f", "t", []),
    ("empty-list-unknown", "empty-list-unknown", UNKNOWN_CODE, "t", []),
    ("zulu", "zulu", "f", "t", ["2024-01-15T08:30:00Z", "2024-01-15"]),
    ("offset", "offset", "f", "t", ["2024-01-15T08:30:00+05:30", "2024-01-15 08:30-0800"]),
    ("basic-iso", "basic-iso", "f", "t", ["20240115T083000", "2024-01-15T08:30:00.123456789", "20240115T0830Z"]),
    ("twice", "twice-1", "f", "t", FIXTURE_DATETIMES[:1]),
    ("twice", "twice-2", "f", "t", FIXTURE_DATETIMES[1:]),
    ("no-service", "no-service", NO_SERVICE_CODE, "f", FIXTURE_DATETIMES),
    # no route leads from a station to itself: tier 3 by day, tier 4 at night
    ("same-station", "same-station", "f", "f", [FIXTURE_DATETIMES[0], "2024-01-15T03:00:00"]),
]


def fixture_stations(stations: DataFrame) -> DataFrame:
    """The stations table with one station that nothing departs from."""
    extra = stations.sparkSession.range(1).select(
        F.lit(NO_SERVICE_STATION).alias("station_name"), F.lit(51.0).alias("latitude"),
        F.lit(-1.0).alias("longitude"), F.lit(NO_SERVICE_CODE).alias("tiploc"))
    return stations.unionByName(extra, allowMissingColumns=True)


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """JSON lines (or parquet) of requests with an array of datetimes; a row
    without ``request_id`` gets a content-derived one.  Ids may repeat: scoring
    tells requests apart by a row id of its own (``scoring.with_row_id``).

    A line that is no such request (broken JSON, a field of another type) is
    kept whole in ``malformed``, with the id of its text unless one can be
    read, and is answered 400; other lines don't suffer from it."""
    if fmt == "json":
        return with_ids(spark.read.schema(LINE_SCHEMA).options(**LINE_OPTIONS).json(path))
    return with_ids(spark.read.format(fmt).schema(REQUEST_SCHEMA).load(path).withColumn("malformed", F.lit(None).cast("string")))


def with_ids(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("malformed"), F.to_json(F.struct("from_tiploc", "to_tiploc", "departure_datetimes")))
    return df.withColumn("request_id", F.coalesce(F.col("request_id"), F.sha2(text, 256)))


def _times(values: list | None):
    kind = "array<string>"
    if values is None:
        return F.lit(None).cast(kind)
    return F.array(*[F.lit(v).cast("string") for v in values]).cast(kind)


def fixture_requests(legs: DataFrame, stations: DataFrame) -> DataFrame:
    """Every distinct (origin, destination) pair of the legs whose stations
    have a code, asked at the three fixture times; plus the ``SPECIAL``
    requests, built from the smallest valid pair."""
    codes = (stations.where(F.col("tiploc").isNotNull()).groupBy("station_name")
             .agg(F.min("tiploc").alias("code")))
    pairs = legs.select("stationName_from", "stationName_to").distinct()
    f = codes.select(F.col("station_name").alias("__fn"), F.col("code").alias("from_tiploc"))
    t = codes.select(F.col("station_name").alias("__tn"), F.col("code").alias("to_tiploc"))
    valid = (pairs.join(f, pairs["stationName_from"] == f["__fn"])
             .join(t, pairs["stationName_to"] == t["__tn"])
             .select(F.concat_ws(">", "from_tiploc", "to_tiploc").alias("request_id"),
                     "from_tiploc", "to_tiploc", _times(FIXTURE_DATETIMES).alias("departure_datetimes")))
    first = valid.agg(F.min(F.struct("from_tiploc", "to_tiploc")).alias("p")).where(
        F.col("p").isNotNull())
    own = {"f": F.col("p.from_tiploc"), "t": F.col("p.to_tiploc")}

    def code(c):
        return own[c] if c in own else F.lit(c).cast("string")

    special = first.select(F.explode(F.array(*[
        F.struct(F.lit(rid).alias("request_id"), code(fr).alias("from_tiploc"), code(to).alias("to_tiploc"),
                 _times(times).alias("departure_datetimes")) for rid, _, fr, to, times in SPECIAL])).alias("r"))
    return valid.unionByName(special.select("r.*"))


def probe_keys(legs: DataFrame) -> DataFrame:
    """Request keys for the service match taken from the legs themselves:
    (origin, destination) at the arrival hour and weekday (tiers 1 and 2) and
    (origin, origin) five hours before departure (tiers 3 and 4)."""
    nxt, dep = F.col("next_station_departure_dt"), F.col("leg_departure_dt")
    a = legs.select(F.col("stationName_from").alias("from_station"),
                    F.col("stationName_to").alias("to_station"),
                    F.hour(nxt).alias("req_hour"), tm.weekday_sunday0(nxt).alias("req_dow"))
    b = legs.select(F.col("stationName_from").alias("from_station"),
                    F.col("stationName_from").alias("to_station"),
                    (F.hour(dep) - 5).alias("req_hour"), tm.weekday_sunday0(dep).alias("req_dow"))
    return a.union(b).where(F.col("from_station").isNotNull()).distinct()
