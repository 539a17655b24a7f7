"""Queries over the driver tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every module of this package once and return (queries, oracles)."""
    from . import registry

    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
    return registry.QUERIES, registry.ORACLES
