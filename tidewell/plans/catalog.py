"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from tidewell.plans import q_cycle, q_demand, q_drift, q_features, q_models, q_reports  # noqa: F401
from tidewell.plans.registry import REGISTRY


def queries():
    return {name: e.fn for name, e in REGISTRY.items()}


def oracle_sql():
    return {name: e.sql for name, e in REGISTRY.items() if e.sql is not None}
