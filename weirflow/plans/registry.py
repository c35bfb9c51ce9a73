"""Every registered query of the library, by name, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

MODULES = ("weekly", "texts", "markets", "increments", "extras", "reports", "alignment")


def _all() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"weirflow.plans.{name}").QUERIES
    return found


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
