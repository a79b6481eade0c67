"""Registered queries: operators bound to the given tables, each with its oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ["logs", "joins", "aggregates", "ranges", "anomalies", "budgets", "detection", "incidents", "similarity", "learning"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"opsignal.plans.{m}")
