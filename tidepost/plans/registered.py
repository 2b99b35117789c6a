"""All registered queries."""

import importlib

from tidepost.plans.book import COUNTERPARTS, QUERIES

for _area in ("scalars", "payloads", "reading", "changing", "matching", "registry", "streams"):
    importlib.import_module(f"tidepost.plans.queries_{_area}")

__all__ = ["COUNTERPARTS", "QUERIES"]
