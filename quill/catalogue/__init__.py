"""Queries over the test tables, one or more for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from .base import ORACLE_SQL, QUERIES

for _m in pkgutil.iter_modules(__path__):
    if _m.name != "base":
        importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
