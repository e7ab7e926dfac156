"""Registered queries, each with its SQL check where one can be written."""

import importlib

MODULES = ("window_queries", "forecast_queries", "test_queries", "calendar_queries",
           "quality_queries", "robust_queries", "relational_queries", "summary_queries", "tree_queries")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"volpanel.catalog.{m}")
