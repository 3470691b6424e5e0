"""Join helper: small sides with known sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from coachload.session import materialize


def small_side(df: DataFrame, name: str = "dimension") -> DataFrame:
    """A table that is expected to be small (stations, label dictionaries),
    written once so that its size in bytes is known.  Whether it is broadcast
    is then Catalyst's decision against autoBroadcastJoinThreshold; a table
    that has grown beyond it is joined by a shuffle, with the same rows."""
    return materialize(df, name)
