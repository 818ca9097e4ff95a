"""Named queries by family; importing a module registers its queries."""

from __future__ import annotations

import importlib

from millrace.registry import REGISTRY, Registry

MODULES = ("tpch_shapes", "decision_support", "retail_shapes", "relational", "statistics_nulls", "storage", "function_families", "edges", "streams")


def load() -> Registry:
    """Imports every family and gives the filled registry."""
    for m in MODULES:
        importlib.import_module(f"millrace.plans.{m}")
    return REGISTRY
