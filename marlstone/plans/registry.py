"""All queries of the library over the test tables, with their SQL oracles."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "i3_summary_metrics"
MODULES = ["evaluation", "cohort", "annotation", "clinical", "resampled", "gates", "reviews", "contracts", "monitors", "fitted", "pictures"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _book = import_module(f"marlstone.plans.{_name}").book
    QUERIES |= _book.queries
    ORACLES |= _book.oracles
