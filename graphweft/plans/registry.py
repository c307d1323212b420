
from __future__ import annotations

import functools
import importlib

GROUPS = ("q_relational", "q_temporal", "q_features", "q_graph", "q_hubs", "q_sampling", "q_ml", "q_io")


def _modules():
    mods = []
    for g in GROUPS:
        try:
            mods.append(importlib.import_module(f"graphweft.plans.{g}"))
        except ModuleNotFoundError as e:
            if e.name != f"graphweft.plans.{g}":
                raise
    return mods


def _utc(fn):
    """All times in the data model are UTC: pin the session time zone for the query."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def all_queries() -> dict:
    out = {}
    for m in _modules():
        out.update({k: _utc(v) for k, v in m.QUERIES.items()})
    return out


def all_oracles() -> dict:
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
