"""Query sets: importing them fills the registry."""

from __future__ import annotations

import importlib

SETS = ["primitives", "scalars", "cohorts", "stages", "timelines", "facts", "orders", "calls",
        "queues", "people", "dashboards", "fraud", "scoring", "forecast"]


def load():
    """The registry with every query set loaded."""
    registry = importlib.import_module("tidemark.plans.registry")
    for name in SETS:
        importlib.import_module(f"tidemark.plans.{name}")
    return registry
