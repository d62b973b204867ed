"""The registry behind ``__spark_entry__``: every operator query and its DuckDB oracle."""

from __future__ import annotations

import importlib

_MODULES = [
    "tabsmith.plans.catalog_profile",
    "tabsmith.plans.catalog_clean",
    "tabsmith.plans.catalog_features",
    "tabsmith.plans.catalog_eval",
    "tabsmith.plans.catalog_models",
]


def _loaded():
    return [importlib.import_module(name) for name in _MODULES]


def all_queries() -> dict:
    out = {}
    for m in _loaded():
        out.update(m.Q)
    return out


def all_oracle_sql() -> dict:
    out = {}
    for m in _loaded():
        out.update(m.SQL)
    return out
