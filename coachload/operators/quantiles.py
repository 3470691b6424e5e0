"""Exact order statistics of a few keys (columns, classes).

A KLL sketch of each key (one pass, merged map-side, some 100 KB a key)
brackets each wanted rank; a second pass counts the values below, between and
above the brackets and keeps the distinct values inside them.  Only these, some
thousandths of the column, are shuffled and ordered: cut into buckets at
approximate quantiles, of which those that hold a wanted rank are ordered, each
by itself.  Spark's exact ``percentile`` instead merges a value -> count map of
the whole column in one task.

A sketch's error is a matter of chance.  The counts prove whether a bracket
holds its rank; if one does not, every distinct value is counted instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coachload.session import materialize

BUCKETS = 200
# Size of a sketch, and a bracket's reach on either side as a share of the
# rows: three times the sketch's stated error of 0.05 %.
SKETCH, REACH = 4096, 0.0015
# Steps of the grid of shares that a sketch is asked for.
GRID = 1000
# Distinct values of all brackets that are ordered on the driver; more are ordered by Spark.
LOCAL_VALUES = 1 << 16


def value_counts(values: DataFrame, key: str = "key", value: str = "v") -> DataFrame:
    """(key, v, n) of the values that aren't null."""
    return (values.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("v"))
            .agg(F.count(F.lit(1)).alias("n")))


def at_ranks(counts: DataFrame, ranks: Callable[[Column], Column] | DataFrame) -> DataFrame:
    """``counts``: (key, v, n).  ``ranks`` turns a key's total into an array of
    0-based ranks, or holds them: (key, ranks: array of (i, rank)).  One row per
    key and rank: (key, total, i, rank, v, before, n), where ``before`` rows
    have smaller values and ``n`` rows equal ones."""
    at = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = counts.groupBy("key").agg(F.percentile_approx("v", at, 1000).alias("edges"))
    placed = counts.join(edges, "key").select(
        "key", "v", "n", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("bucket"))
    by = placed.groupBy("key", "bucket").agg(F.sum("n").alias("held"))
    w = Window.partitionBy("key")
    before = F.sum("held").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    by = by.select("key", "bucket", "held", F.coalesce(before, F.lit(0)).alias("earlier"), F.sum("held").over(w).alias("total"))
    if isinstance(ranks, DataFrame):
        by = by.join(ranks, "key")
    else:
        by = by.withColumn("ranks", F.transform(ranks(F.col("total")), lambda r, i: F.struct(i.alias("i"), r.cast("long").alias("rank"))))
    wanted = by.withColumn("ranks", F.filter("ranks", lambda x: (x["rank"] >= F.col("earlier")) & (
        x["rank"] < F.col("earlier") + F.col("held")))).where(F.size("ranks") > 0)
    inside = placed.join(wanted, ["key", "bucket"])
    running = F.sum("n").over(Window.partitionBy("key", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("before", F.col("earlier") + F.coalesce(running, F.lit(0)))
    hit = inside.select("key", "total", "v", "n", "before", F.explode("ranks").alias("x"))
    return (hit.where((F.col("x.rank") >= F.col("before")) & (F.col("x.rank") < F.col("before") + F.col("n")))
            .select("key", "total", F.col("x.i").alias("i"), F.col("x.rank").alias("rank"), "v", "before", "n"))


def _brackets(values: DataFrame, wanted: Callable[[int], list[int]]) -> dict[str, tuple[int, list[int], list[list[float]]]]:
    """{key: (rows, ranks, disjoint brackets [low, high])} from the sketches."""
    number = ~F.isnan("v")
    sketch = values.groupBy("key").agg(
        F.count("v").alias("n"), F.count_if(number).alias("m"), F.min(F.when(number, F.col("v"))).alias("low"),
        F.max(F.when(number, F.col("v"))).alias("high"), F.kll_sketch_agg_double(F.when(number, F.col("v")), F.lit(SKETCH)).alias("sketch"))
    out: dict[str, tuple[int, list[int], list[list[float]]]] = {}
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    quantiles = F.when(F.col("m") > 0, F.kll_sketch_get_quantile_double("sketch", grid))
    for r in sketch.where("n > 0").select("key", "n", "m", "low", "high", quantiles.alias("q")).collect():
        ranks, spans = wanted(r["n"]), []
        for at in ranks:
            if at >= r["m"]:                  # not a number, the greatest value
                spans.append([math.nan, math.nan])
                continue
            reach = REACH + 2 / r["m"]
            share = (at + 0.5) / r["m"]
            first, last = math.floor((share - reach) * GRID), math.ceil((share + reach) * GRID)
            spans.append([r["low"] if first <= 0 else r["q"][first], r["high"] if last >= GRID else r["q"][last]])
        out[r["key"]] = (r["n"], ranks, spans)
    for key, (n, ranks, spans) in out.items():
        merged: list[list[float]] = []
        for low, high in sorted(spans, key=lambda s: (math.isnan(s[0]), s[0])):
            if merged and (low <= merged[-1][1] or math.isnan(low) and math.isnan(merged[-1][1])):
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        out[key] = (n, ranks, merged)
    return out


def _picked(inside: list, inner: list) -> list[tuple[str, int, int, float]]:
    """(key, total, i, v) from the collected rows of the brackets."""
    rows: dict[tuple[str, int], list[tuple[float, int]]] = {}
    for r in inside:
        rows.setdefault((r["key"], r["region"]), []).append((r["v"], r["n"]))
    out = []
    for key, region, total, own in inner:
        ordered, before = sorted(rows[key, region], key=lambda x: (math.isnan(x[0]), x[0])), 0
        left = sorted(own, key=lambda x: x[1])
        for v, n in ordered:
            while left and left[0][1] < before + n:
                out.append((key, total, left.pop(0)[0], v))
            before += n
    return out


def _bracketed(values: DataFrame, wanted: Callable[[int], list[int]]) -> DataFrame:
    """(key, total, i, v) at the wanted ranks of each key."""
    spark = values.sparkSession
    brackets = _brackets(values, wanted)
    edges = spark.createDataFrame([(k, [s[0] for s in b], [s[1] for s in b]) for k, (_, _, b) in brackets.items()],
                                  "key string, lows array<double>, highs array<double>")
    v = F.col("v")
    above, over = F.size(F.filter("lows", lambda e: e <= v)), F.size(F.filter("highs", lambda e: e < v))
    counts = (values.where(v.isNotNull()).join(F.broadcast(edges), "key")          # a row for each key
              .groupBy("key", (above + over).alias("region"), F.when(above == over + 1, v).alias("v"))
              .agg(F.count(F.lit(1)).alias("n")))
    counts = materialize(counts, "brackets")
    held: dict[str, dict[int, int]] = {}
    distinct = 0
    for r in counts.groupBy("key", "region").agg(F.sum("n").alias("n"), F.count("v").alias("d")).collect():
        held.setdefault(r["key"], {})[r["region"]] = r["n"]
        distinct += r["d"]
    inner, missed = [], False
    for key, (n, ranks, _) in brackets.items():
        before, found = 0, 0
        for region, size in sorted(held.get(key, {}).items()):
            own = [(i, at - before) for i, at in enumerate(ranks) if before <= at < before + size]
            found += len(own)
            missed |= bool(own) and region % 2 == 0
            if own and region % 2:
                inner.append((key, region, n, own))
            before += size
        missed |= found < len(ranks)
    if missed:
        every = value_counts(values)
        ranks = spark.createDataFrame([(k, list(enumerate(r))) for k, (_, r, _) in brackets.items()], "key string, ranks array<struct<i:int,rank:long>>")
        return at_ranks(every, ranks).select("key", "total", "i", "v")
    if distinct <= LOCAL_VALUES:
        return spark.createDataFrame(_picked(counts.where(v.isNotNull()).collect(), inner), "key string, total long, i int, v double")
    kind = "struct<key:string,region:int>"
    ranks = spark.createDataFrame([((k, g), own) for k, g, _, own in inner], f"key {kind}, ranks array<struct<i:int,rank:long>>")
    totals = spark.createDataFrame([(k, n) for k, (n, _, _) in brackets.items()], "key string, total long")
    inside = counts.where(v.isNotNull()).select(F.struct("key", "region").cast(kind).alias("key"), "v", "n")
    return at_ranks(inside, ranks).select(F.col("key.key").alias("key"), "i", "v").join(totals, "key")


def exact_quantiles(values: DataFrame, probs: list[float]) -> DataFrame:
    """``values``: (key, v).  (key, q): linearly interpolated quantiles of each
    key, in the order of ``probs``; keys without values have no row."""
    values = values.select(F.col("key").cast("string").alias("key"), F.col("v").cast("double").alias("v"))

    def wanted(total: int) -> list[int]:
        return [at for p in probs for at in (math.floor((total - 1) * p), math.ceil((total - 1) * p))]

    found = _bracketed(values, wanted)
    wide = found.groupBy("key").agg(F.max("total").alias("total"),
                                    *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(2 * len(probs))])

    def between(j: int, p: float) -> Column:
        pos = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.col(f"v{2 * j}"), F.col(f"v{2 * j + 1}")
        return F.when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    return wide.select("key", F.array(*[between(j, p) for j, p in enumerate(probs)]).alias("q"))


def column_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(key, v) of several numeric columns, the column's name as key."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    return stacked.select("x.*")


def column_quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """One row (q) for one column; q is null if it has no values."""
    q = exact_quantiles(column_values(df, [col]), probs)
    return q.agg(F.max("q").alias("q"))
