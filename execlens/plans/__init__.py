"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scans", "relational", "mutation", "reports", "streams")


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
