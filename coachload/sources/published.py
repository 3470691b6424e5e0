"""Sets of tables that are replaced as a whole.

A set lies in a version folder of its own.  It is published by one more row in
``manifests``, written after all of its tables, so that a reader sees either
the old set or the new one, and a failure between two tables leaves the old one
in place.  Versions are not deleted; the folder needs a retention rule longer
than the longest read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, version string, format string, tables array<string>, buckets map<string,struct<column:string,number:int>>"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str):
    """The manifest row of the set that readers see; None before the first."""
    return manifests(spark, path).orderBy(F.desc("number"), F.desc("version")).first()


def _bucketed(spark: SparkSession, name: str, version: str) -> str:
    """A table name of this session for a version's bucketed files."""
    return f"{name}_{version}"


def publish(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", buckets: dict[str, tuple[str, int]] | None = None) -> str:
    """Writes every table and then the manifest; returns the version.

    ``buckets``: table -> (column, number): written in that many buckets sorted
    by the column, which readers group and join by without an exchange."""
    spark = next(iter(tables.values())).sparkSession
    last, version = current(spark, path), uuid.uuid4().hex
    buckets = buckets or {}
    for name, df in tables.items():
        place = f"{path.rstrip('/')}/versions/{version}/{name}"
        if name in buckets:
            column, number = buckets[name]
            (df.repartition(number, column).write.format(fmt).bucketBy(number, column).sortBy(column).option("path", place)
             .saveAsTable(_bucketed(spark, name, version)))
        else:
            df.write.format(fmt).save(place)
    row = spark.createDataFrame([((last["number"] if last else 0) + 1, version, fmt, sorted(tables), buckets)], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/manifests")
    return version


def read_published(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of one version; all names must be in it."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    lost = sorted(set(names or []) - set(at["tables"]))
    if lost:
        raise KeyError(f"version {at['version']} of {path} has no {', '.join(lost)}")
    out = {}
    for n in names or at["tables"]:
        place, own = f"{path.rstrip('/')}/versions/{at['version']}/{n}", (at["buckets"] or {}).get(n)
        if own is None:
            out[n] = spark.read.format(at["format"]).load(place)
            continue
        name = _bucketed(spark, n, at["version"])
        if not spark.catalog.tableExists(name):       # another session wrote it: the files say the rest
            columns = spark.read.format(at["format"]).load(place).schema.toDDL()
            spark.sql(f"CREATE TABLE {name} ({columns}) USING {at['format']} CLUSTERED BY ({own['column']}) "
                      f"SORTED BY ({own['column']}) INTO {own['number']} BUCKETS LOCATION '{place}'")
        out[n] = spark.table(name)
    return out
