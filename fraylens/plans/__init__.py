"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ["rows", "sequences", "joins", "metrics", "analytics", "reports", "finding", "logs", "stores", "live", "e2e"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"fraylens.plans.{name}")
