"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from tenuria.plans.registry import CHECKS, QUERIES

MODULES = (
    "silver_queries",
    "feature_queries",
    "model_queries",
    "training_queries",
    "explain_queries",
    "insight_queries",
)

for _m in MODULES:
    import_module(f"tenuria.plans.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(CHECKS)
