"""Target labelling and its reports.

Thresholds are one-row aggregates referenced as scalar subqueries, so the
tier assignment is a projection over the fact rows: no join, no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coachload.operators.features import pct_of
from coachload.operators.quantiles import column_quantiles, exact_quantiles

# Fixed values that must equal the reference's.
TIERS = ["Quiet", "Moderate", "Busy"]
# Target codes: alphabetical order of the tier names.
TIER_CODES = {"Busy": 0, "Moderate": 1, "Quiet": 2}
QUANTILE_PROBS = (0.33, 0.67)
FIXED_THRESHOLDS = (40.0, 70.0)
ADAPTIVE_WIDTH = 0.5

OCC = "occupancy_percentage"
TIER = "comfort_tier"


# T1 ------------------------------------------------------------------------
def occupancy_pct(df: DataFrame, num: str = "relevant_passengers_on_leg_departure",
                  den: str = "vehicle_capacity", out: str = OCC) -> DataFrame:
    return df.withColumn(out, pct_of(F.col(num), F.col(den)))


# T2-T4 ---------------------------------------------------------------------
def thresholds(df: DataFrame, method: str = "quantile", col: str = OCC,
               probs=QUANTILE_PROBS, fixed=FIXED_THRESHOLDS,
               width: float = ADAPTIVE_WIDTH) -> DataFrame:
    """One row (low, high); ``quantile`` interpolates exact order statistics."""
    x = F.col(col)
    if method == "quantile":
        q = column_quantiles(df, col, [float(p) for p in probs])
        return q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    if method == "fixed":
        return df.sparkSession.range(1).select(F.lit(float(fixed[0])).alias("low"),
                                               F.lit(float(fixed[1])).alias("high"))
    if method == "adaptive":
        m, s = F.avg(x), F.stddev_samp(x)
        return df.agg((m - F.lit(width) * s).alias("low"), (m + F.lit(width) * s).alias("high"))
    raise ValueError(f"unknown threshold method {method!r}")


def all_thresholds(df: DataFrame, col: str = OCC) -> DataFrame:
    """The three methods side by side, one row per method."""
    parts = [thresholds(df, m, col).select(F.lit(m).alias("method"), "low", "high")
             for m in ("quantile", "fixed", "adaptive")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# T5, T6 --------------------------------------------------------------------
def tier_of(x: Column, low: Column, high: Column) -> Column:
    """<= low Quiet, <= high Moderate, else (including NULL) Busy."""
    return (F.when(x <= low, TIERS[0]).when(x <= high, TIERS[1]).otherwise(TIERS[2]))


def assign_tier(df: DataFrame, thr: DataFrame, col: str = OCC, out: str = TIER) -> DataFrame:
    low = thr.select("low").scalar()
    high = thr.select("high").scalar()
    return df.withColumn(out, tier_of(F.col(col), low, high))


def encode_tier(df: DataFrame, col: str = TIER, out: str = "comfort_tier_encoded") -> DataFrame:
    expr = None
    for name, code in TIER_CODES.items():
        expr = F.when(F.col(col) == name, code) if expr is None else expr.when(F.col(col) == name, code)
    return df.withColumn(out, expr.cast("int"))


def label(df: DataFrame, method: str = "quantile", **kw) -> DataFrame:
    """T1 + T2..T4 + T5 + T6."""
    df = occupancy_pct(df)
    return encode_tier(assign_tier(df, thresholds(df, method, **kw)))


# T7 ------------------------------------------------------------------------
def tier_distribution(df: DataFrame, col: str = TIER) -> DataFrame:
    """(comfort_tier, count, percent), all three tiers even when empty: one
    aggregate of three conditional counts, unpivoted."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(col) == t).alias(t) for t in TIERS])
    long = wide.unpivot(["__n"], TIERS, col, "count")
    return long.select(col, "count", (F.try_divide(F.col("count"), F.col("__n"))
                                      * F.lit(100.0)).alias("percent"))


# T8-T11 --------------------------------------------------------------------
def crosstab_counts(df: DataFrame, row: str, col: str = TIER,
                    values: list[str] | None = None) -> DataFrame:
    """row x tier counts, zero-filled; pivot with the explicit value list."""
    values = values or sorted(TIERS)
    out = df.groupBy(row).pivot(col, values).count()
    return out.fillna(0, subset=values)


def crosstab_pct(df: DataFrame, row: str, col: str = TIER, digits: int | None = 1,
                 values: list[str] | None = None) -> DataFrame:
    """Row percentages (pandas crosstab normalize='index'), half-even rounding."""
    values = values or sorted(TIERS)
    counts = crosstab_counts(df, row, col, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    cols = []
    for v in values:
        pct = F.col(v) / total * F.lit(100.0)
        cols.append((F.bround(pct, digits) if digits is not None else pct).alias(v))
    return counts.select(row, *cols)


def weekend_label(df: DataFrame, col: str = "is_weekend", out: str = "day_type") -> DataFrame:
    return df.withColumn(out, F.when(F.col(col) == 1, "Weekend").otherwise("Weekday"))


# T12-T14 -------------------------------------------------------------------
def box_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Five-number summary (+ whisker ends at 1.5 IQR) per group."""
    x = F.col(value).cast("double")
    key = F.col(by).cast("string") if by else F.lit("")
    some = df.withColumn("__key", F.coalesce(key, F.lit("")))
    stats = some.groupBy("__key", *([by] if by else [])).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(some.select(F.col("__key").alias("key"), x.alias("v")), [0.25, 0.5, 0.75]).withColumnRenamed("key", "__key")
    return stats.join(q, "__key", "left").select(
        *([by] if by else []), "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"), "max")


def histogram(df: DataFrame, col: str = OCC, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max, the last bin closed.

    Bin edges come from a one-row aggregate (scalar subqueries); the counts
    are a partial/final aggregate over at most ``bins`` keys; all bins are
    listed, empty ones with 0.
    """
    x = F.col(col)
    vals = df.where(x.isNotNull())
    lo = vals.agg(F.min(x)).scalar()
    hi = vals.agg(F.max(x)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    idx = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    idx = F.when(hi == lo, F.lit(0)).otherwise(idx)
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(F.broadcast(counts), "bin", "left")
    return out.select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                      (lo + (F.col("bin") + 1) * width).alias("bin_end"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
