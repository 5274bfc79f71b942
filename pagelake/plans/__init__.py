"""Registered queries over the operators, and their SQL."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = ("geometry", "regions", "analytics", "lines", "quads", "texts", "manifests", "logs", "rasters", "streams")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
