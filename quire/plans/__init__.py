"""Query plans: the library's operators bound to the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("text", "reading", "library", "linkage", "replication", "blocks", "layout", "outputs", "live", "flagship")


def load():
    """Import all plan modules and return ``(queries, oracles)``."""
    from quire.plans.registry import ORACLES, QUERIES

    for m in MODULES:
        importlib.import_module(f"quire.plans.{m}")
    return QUERIES, ORACLES
