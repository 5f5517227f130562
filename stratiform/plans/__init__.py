"""Registered queries: operators put together over the tables of a data folder."""

from __future__ import annotations

import importlib
import pkgutil


def all_plans() -> None:
    """Import every module of this package; each registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
