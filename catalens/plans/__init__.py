"""Registered queries over the test tables and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "vectors", "catalogue", "relational", "faceted", "texts", "users", "achievements", "enriching", "exchange", "streams")


def load_all():
    from catalens.plans import registry

    for name in MODULES:
        importlib.import_module(f"catalens.plans.{name}")
    return registry
