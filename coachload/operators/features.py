"""Feature derivation.

Each step is ``DataFrame -> DataFrame`` made of column expressions, so the
whole feature pipeline compiles into one whole-stage-codegen span per scan;
the only shuffles are the label dictionaries (distinct values per column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coachload.functions import geo, time as tm
from coachload.operators.joins import small_side
from coachload.session import materialize

# Values that a literal map of a column's codes holds at most (it is searched in
# order); columns with more are joined.
MAP_VALUES = 256

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# Training flags test exact membership of these names:
LONDON_STATIONS = ["London Paddington", "London Victoria", "London Waterloo",
                   "London Kings Cross"]
MAJOR_CITY_STATIONS = ["Birmingham New Street", "Manchester Piccadilly", "Leeds",
                       "Glasgow Central", "Edinburgh Waverley"]
# Serving flags test substrings:
LONDON_SUBSTRINGS = ["London"]
MAJOR_CITY_SUBSTRINGS = ["Birmingham", "Manchester", "Leeds", "Glasgow", "Edinburgh"]
# Columns label-encoded for the model:
ENCODED_COLUMNS = ["coach_type", "stationName_from", "stationName_to", "headcode",
                   "rsid", "time_period"]
# Selected features, by group, in selection order:
FEATURE_GROUPS = {
    "time": ["hour_of_day", "day_of_week", "month", "is_weekend",
             "time_period_encoded", "is_peak_hour"],
    "location": ["stationName_from_encoded", "stationName_to_encoded", "from_lat",
                 "from_lon", "to_lat", "to_lon", "route_distance_km", "from_london",
                 "to_london", "from_major_city", "to_major_city"],
    "vehicle": ["coach_type_encoded", "vehicle_capacity"],
    "service": ["headcode_encoded", "rsid_encoded"],
    "contextual": ["vehicle_pax_on_arrival_std_at_from",
                   "vehicle_pax_on_arrival_first_at_from",
                   "totalUnitPassenger_at_leg_departure",
                   "onUnitPassenger_at_from_station",
                   "offUnitPassenger_at_from_station",
                   "vehicle_pax_boarded_std_at_from",
                   "vehicle_pax_boarded_first_at_from",
                   "vehicle_pax_alighted_std_at_from",
                   "vehicle_pax_alighted_first_at_from"],
    "occupancy": ["occupancy_percentage_std", "occupancy_percentage_first",
                  "total_occupancy", "total_occupancy_percentage", "boarding_ratio",
                  "alighting_ratio", "capacity_utilization"],
}
# ---------------------------------------------------------------------------


def selected_features() -> list[str]:
    return [f for group in FEATURE_GROUPS.values() for f in group]


# Known only once the leg has left its origin; the reference trains on them.
POST_DEPARTURE = ["totalUnitPassenger_at_leg_departure", "vehicle_pax_boarded_std_at_from",
                  "vehicle_pax_boarded_first_at_from", "vehicle_pax_alighted_std_at_from",
                  "vehicle_pax_alighted_first_at_from", "onUnitPassenger_at_from_station",
                  "offUnitPassenger_at_from_station", "boarding_ratio", "alighting_ratio"]


def groups_before_departure(groups: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The feature groups without the columns that leak the target."""
    return {g: [f for f in fs if f not in POST_DEPARTURE] for g, fs in (groups or FEATURE_GROUPS).items()}


# F1-F5 ----------------------------------------------------------------------
def add_time_features(df: DataFrame, ts: str = "leg_departure_dt",
                      period: str = "train") -> DataFrame:
    """hour, Monday=0 weekday, month, day of month, weekend, period, peak.

    ``period="train"`` uses the right-closed training bins, ``"serve"`` the
    left-closed serving bins (the two differ at hours 6, 9, 12, 17, 20).
    """
    if period not in ("train", "serve"):
        raise ValueError(f"unknown period form {period!r}")
    t = F.col(ts)
    hour = tm.hour_of_day(t)
    dow = tm.weekday_monday0(t)
    bins = tm.time_period_train if period == "train" else tm.time_period_serve
    return df.withColumns({
        "hour_of_day": hour,
        "day_of_week": dow,
        "month": F.month(t),
        "day_of_month": F.dayofmonth(t),
        "is_weekend": tm.is_weekend(dow),
        "time_period": bins(hour),
        "is_peak_hour": tm.is_peak_hour(hour),
    })


# F6-F10 ---------------------------------------------------------------------
def city_flags(name: Column, london: list[str], major: list[str],
               match: str = "exact") -> tuple[Column, Column]:
    if match == "exact":
        return name.isin(london).cast("int"), name.isin(major).cast("int")
    if match == "contains":
        def any_of(words):
            cond = F.lit(False)
            for w in words:
                cond = cond | F.coalesce(name.contains(w), F.lit(False))
            return cond.cast("int")
        return any_of(london), any_of(major)
    raise ValueError(f"unknown match mode {match!r}")


def add_location_features(df: DataFrame, match: str = "exact",
                          distance: str = "haversine",
                          london: list[str] | None = None,
                          major: list[str] | None = None) -> DataFrame:
    from_lat, from_lon = geo.parse_location_strict(F.col("stationLocation_from"))
    to_lat, to_lon = geo.parse_location_strict(F.col("stationLocation_to"))
    df = df.withColumns({"from_lat": from_lat, "from_lon": from_lon,
                         "to_lat": to_lat, "to_lon": to_lon})
    dist = geo.haversine_km if distance == "haversine" else geo.planar_km
    if london is None:
        london = LONDON_STATIONS if match == "exact" else LONDON_SUBSTRINGS
    if major is None:
        major = MAJOR_CITY_STATIONS if match == "exact" else MAJOR_CITY_SUBSTRINGS
    fl, fm = city_flags(F.col("stationName_from"), london, major, match)
    tl, tmj = city_flags(F.col("stationName_to"), london, major, match)
    return df.withColumns({
        "route_distance_km": dist(F.col("from_lat"), F.col("from_lon"),
                                  F.col("to_lat"), F.col("to_lon")),
        "from_london": fl, "to_london": tl,
        "from_major_city": fm, "to_major_city": tmj,
    })


# F11, F12 -------------------------------------------------------------------
def pct_of(num: Column, den: Column) -> Column:
    """num / den * 100 with NULL (not an error, not inf) for a zero den."""
    return F.try_divide(num, den) * F.lit(100.0)


def add_occupancy(df: DataFrame, utilization: bool = False,
                  capacity: str = "vehicle_capacity") -> DataFrame:
    c = F.col
    cap = c(capacity)
    total = c("vehicle_pax_on_arrival_std_at_from") + c("vehicle_pax_on_arrival_first_at_from")
    cols = {
        "occupancy_percentage_std": pct_of(c("vehicle_pax_on_arrival_std_at_from"), cap),
        "occupancy_percentage_first": pct_of(c("vehicle_pax_on_arrival_first_at_from"), cap),
        "total_occupancy": total,
        "total_occupancy_percentage": pct_of(total, cap),
        "boarding_ratio": pct_of(c("vehicle_pax_boarded_std_at_from")
                                 + c("vehicle_pax_boarded_first_at_from"), cap),
        "alighting_ratio": pct_of(c("vehicle_pax_alighted_std_at_from")
                                  + c("vehicle_pax_alighted_first_at_from"), cap),
    }
    if utilization:
        cols["capacity_utilization"] = pct_of(c("relevant_passengers_on_leg_departure"), cap)
    return df.withColumns(cols)


# F13, F14 -------------------------------------------------------------------
def fit_labels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Dictionary (column, value, code), written once: code = 0-based rank of
    the sorted distinct non-null values of each column.

    The rank is distributed: the distinct values (reduced map-side) are sorted
    over range partitions, each numbers its own, and the partitions' counts (a
    row for each column and partition) move the numbers on.  No task holds a
    column, however many values it has.
    """
    cols = [c for c in (cols or ENCODED_COLUMNS) if c in df.columns]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.*")
    distinct = stacked.where(F.col("value").isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(distinct.repartitionByRange(parts, "column", "value").sortWithinPartitions("column", "value")
                         .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "label_ranks")
    held = placed.groupBy("column", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("column", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    return materialize(placed.join(held, ["column", "part"]).select(
        "column", "value", (F.col("at") + F.col("shift")).cast("int").alias("code")), "labels")


def apply_labels(df: DataFrame, labels: DataFrame, cols: list[str] | None = None,
                 unknown: int | None = None, suffix: str = "_encoded") -> DataFrame:
    """Add ``<col>_encoded`` from the dictionary: columns of at most
    ``MAP_VALUES`` values look theirs up in a literal map, others join theirs.

    ``unknown=None`` leaves unseen values NULL (training); ``unknown=0`` is
    the serving behaviour, where an unseen value is coded 0.
    """
    cols = [c for c in (cols or ENCODED_COLUMNS) if c in df.columns]
    held = {r["column"]: r["n"] for r in labels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [c for c in cols if held.get(c, 0) <= MAP_VALUES]
    maps: dict[str, dict] = {c: {} for c in short}
    for r in labels.where(F.col("column").isin(short)).collect() if short else []:
        maps[r["column"]][r["value"]] = r["code"]
    out, added = df, {}
    for c in short:
        if maps[c]:
            keys, codes = zip(*sorted(maps[c].items(), key=lambda x: x[1]))
            code = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(F.lit, codes))), F.col(c).cast("string"))
        else:
            code = F.lit(None)
        added[c + suffix] = (code if unknown is None else F.coalesce(code, F.lit(unknown))).cast("int")
    out = out.withColumns(added) if added else out
    for c in cols:
        if c in short:
            continue
        d = small_side(labels.where(F.col("column") == c).select(
            F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__c_{c}")), "labels")
        out = out.join(d, out[c].cast("string") == d[f"__v_{c}"], "left")
        code = F.col(f"__c_{c}")
        if unknown is not None:
            code = F.coalesce(code, F.lit(unknown))
        out = out.withColumn(c + suffix, code.cast("int")).drop(f"__v_{c}", f"__c_{c}")
    return out


# F15-F18 --------------------------------------------------------------------
def select_features(df: DataFrame, groups: dict[str, list[str]] | None = None,
                    label: str | None = "comfort_tier_encoded",
                    keep: list[str] | None = None):
    """Split the selected names into available / missing; return (X, available,
    missing), X holding the available features (plus label and keep cols)."""
    groups = groups or FEATURE_GROUPS
    wanted = [f for g in groups.values() for f in g]
    available = [f for f in wanted if f in df.columns]
    missing = [f for f in wanted if f not in df.columns]
    extra = list(keep or []) + ([label] if label and label in df.columns else [])
    return df.select(*extra, *available), available, missing


def feature_group_table(spark, columns: list[str],
                        groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(group, position, feature, available) for a schema; a schema report."""
    groups = groups or FEATURE_GROUPS
    rows = [(g, i, f, f in columns) for g, fs in groups.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "feature_group string, position int, feature string, available boolean")


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """F16: null count per column in one pass, as (column, null_count)."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def align(df: DataFrame, feature_list: list[str], fill=0) -> DataFrame:
    """keep known features, add absent ones as ``fill``, training order."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(fill).alias(f)
                       for f in feature_list])


def feature_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, position, value): column counts, then the new columns."""
    new = [c for c in after.columns if c not in before.columns]
    rows = [("original_columns", 0, str(len(before.columns))), ("final_columns", 0, str(len(after.columns))),
            ("new_features", 0, str(len(new))), *[("new_column", i + 1, c) for i, c in enumerate(new)]]
    return after.sparkSession.createDataFrame(rows, "metric string, position int, value string")


def feature_sample(after: DataFrame, columns: list[str], order: list[str], n: int = 5) -> DataFrame:
    """the first rows, by key, of some columns."""
    return after.select(*order, *columns).orderBy(*order).limit(n)


def engineer(legs: DataFrame, labels: DataFrame | None = None,
             period: str = "train", match: str = "exact",
             distance: str = "haversine", utilization: bool = False):
    """F1-F13 in the reference order: time, location, occupancy, encoding.

    Returns (features, labels); pass the training dictionary as ``labels``
    to encode new data with it.
    """
    df = add_time_features(legs, period=period)
    df = add_location_features(df, match=match, distance=distance)
    df = add_occupancy(df, utilization=utilization)
    if labels is None:
        labels = fit_labels(df)
    return apply_labels(df, labels), labels
