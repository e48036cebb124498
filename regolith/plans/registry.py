"""The registered queries over the reference's operators."""

from __future__ import annotations

import importlib

MODULES = ["surface", "clouds", "photometric", "planning", "growing", "details", "refining"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"regolith.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"regolith.plans.{name}").SQL
    return found


def flagship(spark, sf_dir):
    return importlib.import_module("regolith.plans.surface").flagship(spark, sf_dir)
