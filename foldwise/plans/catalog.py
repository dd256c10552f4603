"""The query catalog: one Spark builder and (where SQL can express it) one DuckDB
oracle per operator of the inventory."""

from __future__ import annotations

import importlib

MODULES = [
    "foldwise.plans.q_features",
    "foldwise.plans.q_profile",
    "foldwise.plans.q_rank",
    "foldwise.plans.q_encode",
    "foldwise.plans.q_forensics",
    "foldwise.plans.q_blend",
    "foldwise.plans.q_models",
    "foldwise.plans.q_io",
]


def _load():
    queries, oracle = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
