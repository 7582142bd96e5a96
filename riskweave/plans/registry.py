"""Registry of named queries: a Spark builder and (when SQL-expressible) the
equivalent oracle SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import q_rules, q_quality, q_metrics, q_alerts, q_models, q_reports  # noqa: F401
