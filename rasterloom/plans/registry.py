"""Registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def query(*views: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name. `sql` is the DuckDB oracle;
    the bridge views that it uses are put in front of it."""

    def add(f):
        from .views import with_views

        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql)
        return f

    return add


for _module in ("q_columns", "q_relational", "q_aggregates", "q_windows", "q_graph", "q_pixels", "q_keypoints", "q_jobs", "q_sources", "q_files", "q_streams"):
    importlib.import_module(f"{__package__}.{_module}")
