"""All registered queries and their SQL oracles, by family."""

from __future__ import annotations

import importlib

FAMILIES = ["q_sources", "q_profile", "q_features", "q_target", "q_lookups", "q_scoring",
            "q_model"]


def _load():
    queries, oracles = {}, {}
    for fam in FAMILIES:
        try:
            mod = importlib.import_module(f"coachload.plans.{fam}")
        except ModuleNotFoundError as exc:
            if exc.name == f"coachload.plans.{fam}":
                continue
            raise
        queries.update(mod.QUERIES)
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
