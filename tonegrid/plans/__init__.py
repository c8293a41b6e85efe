"""Named queries over the given tables."""

from __future__ import annotations

import importlib

from tonegrid.plans.registry import QUERIES, SQL

MODULES = ["scalars", "series", "structure", "similarity", "pairing", "quality", "timeline", "catalogue", "learning",
           "spectral", "analysis", "streams"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tonegrid.plans.{m}_queries")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(SQL)
