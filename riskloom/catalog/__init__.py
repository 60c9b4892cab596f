"""Registered queries with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("windows", "landing", "verdicts", "analytics", "rings", "models", "streams")


def load():
    from riskloom.catalog.registry import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"riskloom.catalog.{module}")
    return dict(QUERIES), dict(ORACLES)
