"""Named queries: operators applied to the adapter views, with their twins."""

import importlib

from tallyloom.plans.registry import QUERIES, TWINS, Tables, twin_sql

_MODULES = (
    "views", "scalar_plans", "scoring_plans", "identity_plans", "marks_plans", "review_plans", "cells_plans", "bank_plans",
    "stream_plans", "exam_plans",
)
for _name in _MODULES:
    importlib.import_module(f"tallyloom.plans.{_name}")

__all__ = ["QUERIES", "TWINS", "Tables", "twin_sql"]
