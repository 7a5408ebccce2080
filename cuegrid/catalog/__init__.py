"""Queries over the corpus tables, one per operator, with the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "texts", "timelines", "kernels", "rollups", "tables_io", "streams")


def load():
    """(queries, oracles) with every catalog module imported."""
    from cuegrid.catalog import base

    for name in MODULES:
        try:
            importlib.import_module(f"cuegrid.catalog.{name}")
        except ModuleNotFoundError as exc:
            if f"cuegrid.catalog.{name}" not in str(exc):
                raise
    return base.QUERIES, base.oracles()
