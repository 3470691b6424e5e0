"""Lookup-table build (L1-L14) and its sinks and checks.

Station dimension: codes are normalized and deduplicated, journey stations
are consolidated by normalized name, and codes are matched primary-first
with two fallbacks.  The three fallback joins are left joins against
deduplicated (hence at most one row per key) code tables, so the station
count never grows and no row-by-row update is needed.

Aggregates: service routes, historical averages and coach info are plain
grouped aggregates (partial aggregation map-side, one exchange each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coachload.functions import geo, time as tm
from coachload.functions.names import best_name, normalize_name
from coachload.operators.joins import small_side
from coachload.session import materialize
from coachload.sources.published import publish, read_published

# What the metadata row says of a lookup set unless the caller says otherwise.
SOURCE_DATASET = "journey legs"
PURPOSE = "lookup tables for comfort scoring"
# Fixed values that must equal the reference's.
REQUIRED_TABLES = ["stations", "service_routes_summary_mvp", "historical_averages",
                   "coach_info", "metadata"]
MIN_OBSERVATIONS = 3
STATION_COLUMNS = ["station_name", "latitude", "longitude", "tiploc", "crs",
                   "tiploc_orig_desc", "tiploc_orig_tps_desc"]


def _first_by(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple.

    ``min_by`` over a struct is an ordinary aggregate, so duplicates are
    reduced map-side before the shuffle (a hot key never lands whole in one
    task the way a window partition would).
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]),
                 F.struct(*[F.col(c) for c in order])).alias("__r"))
    return picked.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


# L1-L3 ---------------------------------------------------------------------
def dedup_codes(codes: DataFrame) -> DataFrame:
    """Codes with normalized names and the name chosen for matching.

    Drops rows without a usable name, then keeps one row per code and one
    row per matching name (the reference keeps file order; we keep the
    smallest (name, code, ...) so the choice is deterministic).
    """
    # Both names are normalized inside one ``transform`` so the (long) regex
    # chain is evaluated once per name instead of being inlined into every
    # later reference by the optimizer.
    norm = F.transform(F.array("desc_name", "tps_desc_name"), normalize_name)
    c = codes.select(
        "tiploc", norm.alias("__norm"),
        F.col("desc_name").alias("tiploc_orig_desc"),
        F.col("tps_desc_name").alias("tiploc_orig_tps_desc"), "crs")
    c = c.select("tiploc", F.col("__norm")[0].alias("normalized_desc_name"),
                 F.col("__norm")[1].alias("normalized_tps_desc_name"),
                 "tiploc_orig_desc", "tiploc_orig_tps_desc", "crs")
    c = c.withColumn("primary_name", best_name(F.col("normalized_tps_desc_name"),
                                               F.col("normalized_desc_name")))
    c = c.where(F.col("primary_name").isNotNull())
    order = ["primary_name", "normalized_desc_name", "normalized_tps_desc_name",
             "tiploc_orig_desc", "tiploc_orig_tps_desc", "crs"]
    c = _first_by(c, "tiploc", order)
    return _first_by(c, "primary_name", ["tiploc"] + order[1:])


# L4, L5 --------------------------------------------------------------------
def station_locations(legs: DataFrame) -> DataFrame:
    """Distinct (stationName, stationLocation) from both ends of the legs."""
    a = legs.select(F.col("stationName_from").alias("stationName"),
                    F.col("stationLocation_from").alias("stationLocation"))
    b = (legs.where(F.col("stationName_to").isNotNull())
         .select(F.col("stationName_to").alias("stationName"),
                 F.col("stationLocation_to").alias("stationLocation")))
    both = a.union(b).distinct()
    return both.where(F.col("stationName").isNotNull() & (F.trim("stationName") != "")
                      & F.col("stationLocation").isNotNull()
                      & (F.trim("stationLocation") != ""))


def consolidate(locs: DataFrame) -> DataFrame:
    """One row per normalized name: smallest (name, location) pair."""
    n = locs.select(normalize_name(F.col("stationName")).alias("normalized_name"),
                    F.col("stationName").alias("station_name"),
                    F.col("stationLocation").alias("station_location"))
    n = n.where(F.col("normalized_name").isNotNull())
    return _first_by(n, "normalized_name", ["station_name", "station_location"])


# L6, L7 --------------------------------------------------------------------
_CODE_FIELDS = ["tiploc", "crs", "tiploc_orig_desc", "tiploc_orig_tps_desc"]


def match_codes(stations: DataFrame, codes: DataFrame) -> DataFrame:
    """Primary match on the chosen name; for the rest, the description
    alternative, then the tps alternative (each only where it differs from
    the chosen name).  Adds the code fields and ``match_source``."""
    codes = small_side(codes, "codes")   # read three times below

    def side(df: DataFrame, key: str, tag: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{tag}_key"),
                         *[F.col(c).alias(f"{tag}_{c}") for c in _CODE_FIELDS])

    primary = side(codes, "primary_name", "p")
    desc_alt = _first_by(
        codes.where(F.col("normalized_desc_name").isNotNull()
                    & (F.col("normalized_desc_name") != F.col("primary_name"))),
        "normalized_desc_name", ["tiploc", "crs", "tiploc_orig_desc", "tiploc_orig_tps_desc"])
    tps_alt = _first_by(
        codes.where(F.col("normalized_tps_desc_name").isNotNull()
                    & (F.col("normalized_tps_desc_name") != F.col("primary_name"))),
        "normalized_tps_desc_name", ["tiploc", "crs", "tiploc_orig_desc", "tiploc_orig_tps_desc"])
    d = side(desc_alt, "normalized_desc_name", "d")
    t = side(tps_alt, "normalized_tps_desc_name", "t")
    key = F.col("normalized_name")
    j = (stations.join(primary, key == F.col("p_key"), "left")
         .join(d, key == F.col("d_key"), "left")
         .join(t, key == F.col("t_key"), "left"))
    src = (F.when(F.col("p_tiploc").isNotNull(), "primary")
           .when(F.col("d_tiploc").isNotNull(), "description")
           .when(F.col("t_tiploc").isNotNull(), "tps"))

    def pick(field: str) -> Column:
        return (F.when(F.col("p_tiploc").isNotNull(), F.col(f"p_{field}"))
                .when(F.col("d_tiploc").isNotNull(), F.col(f"d_{field}"))
                .when(F.col("t_tiploc").isNotNull(), F.col(f"t_{field}")))

    return j.select(*stations.columns, *[pick(f).alias(f) for f in _CODE_FIELDS],
                    src.alias("match_source"))


# L8, L9 --------------------------------------------------------------------
def build_stations(legs: DataFrame, codes: DataFrame, keep_source: bool = False) -> DataFrame:
    """The stations table (station_name, latitude, longitude, tiploc, crs,
    tiploc_orig_desc, tiploc_orig_tps_desc)."""
    matched = match_codes(consolidate(station_locations(legs)), dedup_codes(codes))
    lat, lon = geo.parse_location_tolerant(F.col("station_location"))
    out = matched.withColumns({"latitude": lat, "longitude": lon})
    cols = STATION_COLUMNS + (["match_source"] if keep_source else [])
    return out.select(*cols)


# L10 -----------------------------------------------------------------------
def match_report(stations: DataFrame) -> DataFrame:
    src = F.col("match_source")
    return stations.agg(
        F.count(F.lit(1)).alias("stations"),
        F.count(F.col("tiploc")).alias("matched"),
        F.count_if(F.col("tiploc").isNull()).alias("unmatched"),
        F.count_if(src == "primary").alias("matched_primary"),
        F.count_if(src == "description").alias("matched_description"),
        F.count_if(src == "tps").alias("matched_tps"))


# L11-L14 -------------------------------------------------------------------
def service_routes(legs: DataFrame) -> DataFrame:
    """Route patterns: (headcode, rsid, from, to, hour, Sunday=0 weekday)
    with their frequency."""
    ts = F.col("leg_departure_dt")
    keys = ["headcode", "rsid", "stationName_from", "stationName_to"]
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return (legs.where(cond)
            .groupBy(*keys, F.hour(ts).alias("hour"),
                     tm.weekday_sunday0(ts).alias("day_of_week"))
            .agg(F.count(F.lit(1)).alias("frequency")))


HIST_AVERAGES = [
    ("vehicle_pax_on_arrival_std_at_from", "avg_vehicle_pax_on_arrival_std"),
    ("vehicle_pax_on_arrival_first_at_from", "avg_vehicle_pax_on_arrival_first"),
    ("totalUnitPassenger_at_leg_departure", "avg_total_unit_pax_on_arrival"),
    ("onUnitPassenger_at_from_station", "avg_unit_boarders_at_station"),
    ("offUnitPassenger_at_from_station", "avg_unit_alighters_at_station"),
]


def historical_averages(legs: DataFrame, min_obs: int = MIN_OBSERVATIONS) -> DataFrame:
    ts = F.col("leg_departure_dt")
    g = (legs.where(F.col("headcode").isNotNull() & F.col("rsid").isNotNull()
                    & F.col("stationName_from").isNotNull())
         .groupBy("headcode", "rsid", F.col("stationName_from").alias("station_of_arrival"),
                  tm.weekday_sunday0(ts).alias("day_of_week_bucket"),
                  tm.time_bucket(F.hour(ts)).alias("time_of_day_bucket"))
         .agg(*[F.coalesce(F.avg(F.col(src).cast("double")), F.lit(0.0)).alias(dst)
                for src, dst in HIST_AVERAGES],
              F.count(F.lit(1)).alias("observations")))
    return g.where(F.col("observations") >= min_obs)


def coach_info(legs: DataFrame) -> DataFrame:
    return (legs.where(F.col("coach_type").isNotNull()).groupBy("coach_type")
            .agg(F.coalesce(F.avg("vehicle_capacity"), F.lit(0.0)).alias("avg_capacity"),
                 F.count(F.lit(1)).alias("frequency"))
            .orderBy(F.desc("frequency"), "coach_type"))


def build_lookups(legs: DataFrame, codes: DataFrame, with_timestamp: bool = True) -> dict[str, DataFrame]:
    """The lookup set.  Its tables are read by whoever writes them and counted
    by the metadata, so they are computed once and stored."""
    tables = {
        "stations": build_stations(legs, codes),
        "service_routes_summary_mvp": service_routes(legs),
        "historical_averages": historical_averages(legs),
        "coach_info": coach_info(legs),
    }
    tables = {name: materialize(df, name) for name, df in tables.items()}
    tables["metadata"] = metadata(tables, legs, with_timestamp)
    return tables


# S3 ------------------------------------------------------------------------
def write_lookups(tables: dict[str, DataFrame], path: str,
                  route_partitions: int | None = None) -> None:
    """Replace the lookup set under ``path`` as a whole (``published``).

    The route table is the only one that grows with the data; with
    ``route_partitions`` it is written in that many buckets of the origin
    station, so that the service match reduces it without an exchange.
    """
    publish(tables, path, buckets={"service_routes_summary_mvp": ("stationName_from", route_partitions)} if route_partitions else None)


def read_lookups(spark, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """One published version's tables."""
    return read_published(spark, path, names or REQUIRED_TABLES)


# S4 ------------------------------------------------------------------------
def metadata(tables: dict[str, DataFrame], legs: DataFrame, with_timestamp: bool = True,
             source_dataset: str = SOURCE_DATASET, purpose: str = PURPOSE) -> DataFrame:
    """One row of table counts; each count is a scalar subquery."""
    def n(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    cols = []
    if with_timestamp:
        cols.append(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                    .alias("created_at"))
    base = legs.agg(F.count(F.lit(1)).alias("total_source_records_in_legs"))
    return base.select(
        *cols, F.lit(source_dataset).alias("source_dataset"),
        "total_source_records_in_legs",
        n(tables["stations"]).alias("stations_count"),
        n(tables["service_routes_summary_mvp"]).alias("service_patterns_count"),
        n(tables["historical_averages"]).alias("historical_patterns_count"),
        n(tables["coach_info"]).alias("coach_types_count"),
        F.lit(purpose).alias("purpose"))


# S5 ------------------------------------------------------------------------
def validate_lookups(tables: dict[str, DataFrame], sample_station: str) -> DataFrame:
    """(check, passed, value) rows: tables present, row counts, coordinate
    lookup of a known station, and the name -> code -> name round trip."""
    spark = next(iter(tables.values())).sparkSession
    missing = [t for t in REQUIRED_TABLES if t not in tables]
    parts = [spark.range(1).select(F.lit("tables_present").alias("check"),
                                   F.lit(not missing).alias("passed"),
                                   F.lit(",".join(missing)).alias("value"))]
    for t in REQUIRED_TABLES:
        if t not in tables:
            continue
        cnt = tables[t].agg(F.count(F.lit(1)).alias("n"))
        ok = (F.col("n") > 0) if t == "stations" else F.lit(True)
        parts.append(cnt.select(F.lit(f"rows:{t}").alias("check"), ok.alias("passed"),
                                F.col("n").cast("string").alias("value")))
    if "stations" in tables:
        st = tables["stations"]
        name = F.lit(sample_station)
        coords = st.where(F.col("station_name") == name).agg(
            F.min_by(F.concat_ws(",", F.col("latitude").cast("string"),
                                 F.col("longitude").cast("string")),
                     F.struct("latitude", "longitude")).alias("v"))
        parts.append(coords.select(F.lit("station_coordinates").alias("check"),
                                   F.col("v").isNotNull().alias("passed"),
                                   F.coalesce(F.col("v"), F.lit("")).alias("value")))
        code = st.where((F.col("station_name") == name) & F.col("tiploc").isNotNull()).agg(
            F.min("tiploc").alias("code"))
        back = code.join(st.select("tiploc", "station_name"),
                         F.col("code") == F.col("tiploc"), "left").groupBy("code").agg(
            F.min("station_name").alias("name_back"))
        parts.append(back.select(
            F.lit("code_round_trip").alias("check"),
            (F.col("code").isNotNull() & F.col("name_back").isNotNull()).alias("passed"),
            F.coalesce(F.concat(F.col("code"), F.lit("->"), F.col("name_back")), F.lit(""))
            .alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
