"""Registered queries: each pairs a Spark plan with the SQL that must agree with it."""

from __future__ import annotations

import importlib

from .registry import REGISTRY

FAMILIES = (
    "q_pit", "q_windows", "q_aggregate", "q_functions", "q_sources", "q_versions", "q_joins",
    "q_events", "q_topk", "q_stats", "q_folds", "q_outcomes", "q_validate", "q_audit",
)


def load() -> dict:
    for name in FAMILIES:
        importlib.import_module(f"{__name__}.{name}")
    return REGISTRY
