"""All queries of the market operators, by name, and SQL that gives the same rows."""

from __future__ import annotations

import importlib

_MODULES = ["offers", "rankings", "joins", "vectors", "pricing", "profiles", "history", "text", "records", "events", "market", "decisions", "fields", "writes"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"marketloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
