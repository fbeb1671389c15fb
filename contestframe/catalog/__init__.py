"""Registered queries: each runs an operator over the given tables, most with an equivalent SQL text."""

from __future__ import annotations

import importlib

from contestframe.catalog.base import ORACLES, QUERIES

MODULES = ["history", "fields", "ledger", "tickq", "rules", "pipelines", "streams", "models", "stored"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"contestframe.catalog.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
