"""Imports the modules whose import registers the queries."""

from __future__ import annotations

import importlib

FAMILIES = ("rfm", "segments", "value", "cohorts", "drift", "lookalike", "pricing", "temporal", "rules", "clustering", "accounts", "operations")


def load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"tessella.plans.{name}_queries")
