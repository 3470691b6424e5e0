"""Coordinate parsing and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: default coordinates for
# missing or unparsable locations, and the Earth radius in km.
DEFAULT_LAT = 54.0
DEFAULT_LON = -2.0
EARTH_RADIUS_KM = 6371.0
DEGREE_KM = 111.0


def parse_location_strict(loc: Column) -> tuple[Column, Column]:
    """Training form: split on every comma, items 0 and 1, '' is missing.

    A non-numeric item fails the job (ANSI cast), as the reference raises.
    """
    parts = F.split(loc, ",")
    lat = F.nullif(F.get(parts, 0), F.lit("")).cast("double")
    lon = F.nullif(F.get(parts, 1), F.lit("")).cast("double")
    return F.coalesce(lat, F.lit(DEFAULT_LAT)), F.coalesce(lon, F.lit(DEFAULT_LON))


def parse_location_tolerant(loc: Column) -> tuple[Column, Column]:
    """Lookup form: split once, anything unparsable falls back to the default."""
    parts = F.split(loc, ",", 2)
    lat = F.get(parts, 0).try_cast("double")
    lon = F.get(parts, 1).try_cast("double")
    return F.coalesce(lat, F.lit(DEFAULT_LAT)), F.coalesce(lon, F.lit(DEFAULT_LON))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    la1, lo1, la2, lo2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin((la2 - la1) / 2), 2)
         + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2)) * F.lit(DEGREE_KM)
