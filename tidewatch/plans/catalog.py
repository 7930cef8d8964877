"""Registry of the surveillance queries and their SQL twins."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

#: Modules that register queries.
MODULES = ("feeds", "aggregates", "windows", "books", "detectors", "macro", "alerts", "surface", "streams", "audit_calls")

for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
