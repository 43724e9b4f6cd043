from __future__ import annotations

import importlib

MODULES = (
    "views",
    "daily_queries",
    "source_queries",
    "quality_queries",
    "xsection_queries",
    "book_queries",
    "inference_queries",
    "model_queries",
    "tax_queries",
    "stream_queries",
)


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"panelmill.plans.{name}")
    return importlib.import_module("panelmill.plans.registry")
