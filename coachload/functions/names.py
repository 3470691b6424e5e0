"""Station-name normalization and choice (L1, L2), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip(s: Column) -> Column:
    """Strip Unicode whitespace at both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normalize_name(name: Column) -> Column:
    """trim, lower, drop a trailing ' <digits>', '&' -> 'and', drop
    punctuation (Unicode-aware word characters), collapse spaces; '' -> NULL."""
    s = _strip(F.lower(name))
    s = F.regexp_replace(s, r"(?U)\s+\d+$", "")
    s = F.regexp_replace(s, "&", "and")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", "")
    s = _strip(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.nullif(s, F.lit(""))


def best_name(tps_norm: Column, desc_norm: Column, min_len: int = 3,
              slack: int = 2) -> Column:
    """Prefer the tps name when usable and not clearly shorter than the
    description; else the description; else NULL."""
    tps_ok = tps_norm.isNotNull() & (F.length(tps_norm) > min_len)
    desc_ok = desc_norm.isNotNull() & (F.length(desc_norm) > min_len)
    return (F.when(tps_ok & desc_ok & (F.length(tps_norm) >= F.length(desc_norm) - slack), tps_norm)
            .when(tps_ok & desc_ok, desc_norm)
            .when(tps_ok, tps_norm)
            .when(desc_ok, desc_norm))
