"""Queries over the test tables, by topic, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

TOPICS = ("retrieval", "joins", "analytics", "casework", "intake", "catalogue")


def _topics() -> list:
    return [import_module(f"briefmill.plans.{t}") for t in TOPICS]


def queries() -> dict[str, Callable]:
    return {k: f for t in _topics() for k, f in t.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for t in _topics() for k, q in t.ORACLE.items()}
