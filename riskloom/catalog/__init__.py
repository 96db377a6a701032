"""Named queries over the given tables, one per operator, each with its SQL twin."""

from __future__ import annotations

import importlib

from riskloom.catalog import registry

MODULES = ("q_frames", "q_risk", "q_series", "q_attr", "q_build", "q_desk", "q_universe", "q_sources", "q_misc", "q_changes", "q_audit", "q_grid", "q_store")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"riskloom.catalog.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
