"""Connected components by alternating large and small stars.

Every round is two grouped minima, each joined back, so a hub with very many
links is combined before the shuffle and its join can be split.  Links stay
distributed; each round is written to the shared folder.  They are done once
every node either has links up to it or one link down: the smallest node of a
star is its root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored

ROUNDS = 50


def _large(edges: DataFrame) -> DataFrame:
    """As many links as ``edges``, repeated ones included: ``_small`` makes
    them distinct."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = F.col("b") == F.col("m")
    return (edges.join(least, "a").select(F.when(own, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .distinct())


def settled(edges: DataFrame) -> bool:
    """Whether distinct links with a > b are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(edges.select("b", F.lit(0)))
    of = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return not of.agg(F.count_if((F.col("down") > 0) & (F.col("n") > 1))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """Links (a, b), long -> (node, root): every node with a link, and the
    smallest node it reaches."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    for _ in range(ROUNDS):
        if settled(edges):
            break
        edges = stored(_small(_large(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node")))
