"""All registered queries; importing a module registers its entries."""

from __future__ import annotations

from importlib import import_module

from . import base

MODULES = ["text_fields", "filtering", "joining", "reports", "summaries", "landing", "cycles", "sql_calls"]


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracles():
    _load()
    return dict(base.ORACLES)
