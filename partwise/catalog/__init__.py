"""Registered queries: every operator run on the driver's tables, with its SQL."""

from __future__ import annotations

import importlib

_MODULES = ["scans", "columns", "joins", "aggregates", "statistics", "windows", "resampling", "fits", "ledgers", "studies"]


def _load():
    from partwise.catalog import registry

    for m in _MODULES:
        try:
            importlib.import_module(f"partwise.catalog.{m}")
        except ModuleNotFoundError as exc:
            if exc.name != f"partwise.catalog.{m}":
                raise
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().ORACLES)
