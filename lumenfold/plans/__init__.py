"""Query catalogue of the core."""

from __future__ import annotations

from importlib import import_module

from lumenfold.registry import CORE, Registry

MODULES = ("search", "tracks", "quality", "ingest", "storage", "finder")


def load_core() -> Registry:
    """Imports the catalogue modules (each registers its queries once) and returns the registry."""
    for name in MODULES:
        import_module(f"lumenfold.plans.{name}")
    return CORE
