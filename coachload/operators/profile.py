"""Data profiling.

Every report is a single aggregate pass (wide row) unpivoted into a long
table, or a grouped count; no collect, no per-column job loop.  The one-row
reports can also be gathered while a table is written (``ScanReports``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coachload.operators.quantiles import column_quantiles, column_values, exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _explode_structs(wide: DataFrame, structs: list) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# E1 ------------------------------------------------------------------------
def column_profile(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, non_null_count, row_count)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count(F.col(c)).alias(f"__nn{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("data_type"),
                        F.col(f"__nn{i}").alias("non_null_count"),
                        F.col("__rows").alias("row_count"))
               for i, f in enumerate(df.schema.fields)]
    return _explode_structs(wide, structs)


def head_rows(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """First rows after a key sort (deterministic ``head``): a top-k."""
    return df.orderBy(*(order or df.columns[:1])).limit(n)


# E2 / F16 ------------------------------------------------------------------
def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, missing_count, missing_percentage) for columns with
    missing values, most missing first."""
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"__m{i}").alias("missing_count"),
                        (F.try_divide(F.col(f"__m{i}"), F.col("__rows")) * F.lit(100.0))
                        .alias("missing_percentage"))
               for i, c in enumerate(cols)]
    out = _explode_structs(wide, structs)
    return out.where(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "column_name")


# E3 / T14 ------------------------------------------------------------------
def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, std (ddof=1), min, 25/50/75 % (linear), max per column."""
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"__n{i}"), F.avg(x).alias(f"__a{i}"),
                 F.stddev_samp(x).alias(f"__s{i}"), F.min(x).alias(f"__lo{i}"),
                 F.max(x).alias(f"__hi{i}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"__n{i}").alias("count"),
                        F.col(f"__a{i}").alias("mean"), F.col(f"__s{i}").alias("std"),
                        F.col(f"__lo{i}").alias("min"), F.col(f"__hi{i}").alias("max"))
               for i, c in enumerate(cols)]
    q = exact_quantiles(column_values(df, cols), [0.25, 0.5, 0.75]).withColumnRenamed("key", "column_name")
    return _explode_structs(wide, structs).join(q, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"), "max")


# E4, E8, E9 ----------------------------------------------------------------
def top_values(df: DataFrame, cols: list[str] | None = None, n: int = 10) -> DataFrame:
    """Top-n value counts per string column, nulls excluded, ties by value.

    The per-column ``row_number <= n`` filter lets Spark insert a partial
    window-group limit before the exchange, so each map task ships at most
    n rows per column, even for key-like columns with millions of values.
    """
    cols = cols or string_columns(df)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in cols]))
        .alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    counts = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def value_counts(df: DataFrame, col: str, n: int | None = None,
                 out: str | None = None) -> DataFrame:
    """(value, count) by count descending, ties by value; top-n if given."""
    out = out or col
    res = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(out))
           .agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.desc("count"), F.asc(out)))
    return res.limit(n) if n else res


# E5 ------------------------------------------------------------------------
def date_span(df: DataFrame, col: str = "leg_departure_dt") -> DataFrame:
    x = F.col(col)
    return df.agg(F.min(x).alias("first"), F.max(x).alias("last")).select(
        "first", "last", F.timestamp_diff("DAY", F.col("first"), F.col("last")).alias("span_days"))


# E6 ------------------------------------------------------------------------
def target_stats(df: DataFrame, col: str = "relevant_passengers_on_leg_departure") -> DataFrame:
    x = F.col(col)
    median = column_quantiles(df, col, [0.5]).select(F.col("q")[0]).scalar()
    return (df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
            .select("min", "max", "mean", median.alias("median"), "std"))


# E7 ------------------------------------------------------------------------
def iqr_outliers(df: DataFrame, col: str = "relevant_passengers_on_leg_departure",
                 k: float = 1.5) -> DataFrame:
    """Q1/Q3 (linear), bounds Q -/+ k*IQR, strict outside count and share.

    The quartiles are a one-row aggregate used as scalar subqueries; the
    count is a second pass with a plain predicate.
    """
    x = F.col(col)
    quart = column_quantiles(df, col, [0.25, 0.75])
    q1 = quart.select(F.col("q")[0]).scalar()
    q3 = quart.select(F.col("q")[1]).scalar()
    iqr = q3 - q1
    lower = q1 - F.lit(k) * iqr
    upper = q3 + F.lit(k) * iqr
    counted = df.agg(F.count(F.lit(1)).alias("rows"),
                     F.count_if((x < lower) | (x > upper)).alias("outliers"))
    return counted.select(q1.alias("q1"), q3.alias("q3"), iqr.alias("iqr"),
                          lower.alias("lower_bound"), upper.alias("upper_bound"),
                          "outliers", (F.try_divide(F.col("outliers"), F.col("rows"))
                                       * F.lit(100.0)).alias("outlier_percentage"))


# E10, E11 ------------------------------------------------------------------
def by_hour(df: DataFrame, ts: str = "leg_departure_dt", n: int | None = 10) -> DataFrame:
    """Departures per hour, sorted by hour, first n hours (not ranked)."""
    res = (df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("count"))
           .orderBy("hour"))
    return res.limit(n) if n else res


def by_day_name(df: DataFrame, ts: str = "leg_departure_dt") -> DataFrame:
    return (df.groupBy(F.date_format(ts, "EEEE").alias("day_name"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "day_name"))


# E12 -----------------------------------------------------------------------
def correlations(df: DataFrame, target: str = "relevant_passengers_on_leg_departure",
                 cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each numeric column with the target (pairwise
    complete), target excluded, strongest positive first."""
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    y = F.col(target).cast("double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"__r{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"__r{i}").alias("correlation"))
               for i, c in enumerate(cols)]
    return _explode_structs(wide, structs).orderBy(F.desc("correlation"), "column_name")


# E13 -----------------------------------------------------------------------
def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (nulls equal).

    Two steps in one plan, so the whole table is not shuffled by all its
    columns: a grouped count on a 64-bit row hash (partial aggregation, a few
    bytes per row cross the network) finds the hashes seen more than once, and
    only rows with such a hash (semi join) are grouped by all columns, which
    keeps the result exact under hash collisions.
    """
    cols = df.columns
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(c) for c in cols]))
    cand = (hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__c"))
            .where(F.col("__c") > 1).select("__h"))
    groups = hashed.join(cand, "__h", "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint")
                      .alias("duplicate_rows"))


# E14 -----------------------------------------------------------------------
def quality_summary(df: DataFrame, target: str = "relevant_passengers_on_leg_departure",
                    k: float = 1.5) -> DataFrame:
    """One row: records, feature counts by kind, nulls, duplicates, target
    range and outliers.

    Three passes: the quartiles (a one-row scalar subquery), one aggregate
    for counts, nulls, range and the outlier count, and the duplicate
    grouping (a second scalar subquery).
    """
    num = numeric_columns(df)
    cat = string_columns(df)
    x = F.col(target)
    quart = column_quantiles(df, target, [0.25, 0.75])
    q1 = quart.select(F.col("q")[0]).scalar()
    q3 = quart.select(F.col("q")[1]).scalar()
    lower, upper = q1 - F.lit(k) * (q3 - q1), q3 + F.lit(k) * (q3 - q1)
    dups = duplicate_count(df).select("duplicate_rows").scalar()
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("bigint")
    base = df.agg(F.count(F.lit(1)).alias("total_records"), nulls.alias("missing_values"),
                  F.min(x).alias("target_min"), F.max(x).alias("target_max"),
                  F.count_if((x < lower) | (x > upper)).alias("outliers"))
    return base.select(
        "total_records", F.lit(len(df.columns)).alias("total_features"),
        F.lit(len(num)).alias("numerical_features"), F.lit(len(cat)).alias("categorical_features"),
        "missing_values", dups.alias("duplicate_rows"), "target_min", "target_max", "outliers",
        (F.try_divide(F.col("outliers"), F.col("total_records")) * F.lit(100.0))
        .alias("outlier_percentage"))


# E1, E2, E5, E12, F16, M2 in one scan -----------------------------------------
class ScanReports:
    """One-row reports of a table that is being written anyway: ``watch`` adds
    the aggregates to the plan as observed metrics, and once the write is done
    the reports need no pass of their own."""

    def __init__(self, df: DataFrame, target: str | None = None, date: str | None = None, label: str | None = None):
        self.fields, self.spark = df.schema.fields, df.sparkSession
        self.target, self.date, self.label = target, date, label
        self.numeric = [c for c in numeric_columns(df) if target and c != target]
        self.seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f.name)).alias(f"n{i}") for i, f in enumerate(self.fields)]]
        if self.target:
            y = F.col(self.target).cast("double")
            aggs += [F.corr(F.col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(self.numeric)]
        if self.date:
            aggs += [F.min(self.date).alias("first"), F.max(self.date).alias("last")]
        if self.label:
            aggs += [F.count_if(F.col(self.label) == k).alias(f"k{k}") for k in range(3)]
        return df.observe(self.seen, *aggs)

    def tables(self) -> dict[str, DataFrame]:
        """After the write: ``columns`` (E1), ``missing`` (E2, F16), and as far
        as they were asked for ``correlations`` (E12), ``dates`` (E5) and
        ``labels`` (M2)."""
        got, make = self.seen.get, self.spark.createDataFrame
        n = got["rows"]
        held = [(i, f.name, f.dataType.simpleString(), got[f"n{i}"]) for i, f in enumerate(self.fields)]
        out = {"columns": make([(*h, n) for h in held], "position int, column_name string, data_type string, non_null_count long, row_count long"),
               "missing": make([(c, n - k, (n - k) / n * 100.0) for _, c, _, k in held if k < n],
                               "column_name string, missing_count long, missing_percentage double")}
        if self.target:
            out["correlations"] = make([(c, got[f"r{i}"]) for i, c in enumerate(self.numeric)], "column_name string, correlation double")
        if self.date:
            first, last = got["first"], got["last"]
            out["dates"] = make([(first, last, (last - first).days if n else None)], "first timestamp_ntz, last timestamp_ntz, span_days long")
        if self.label:
            out["labels"] = make([(k, got[f"k{k}"]) for k in range(3)], f"{self.label} int, count long")
        return out
