"""Queries on the given tables, and their SQL."""

from __future__ import annotations


def _load() -> None:
    from autolot.plans import aggregates, ingest, jobs, matching, scoring, texts  # noqa: F401


def queries() -> dict:
    from autolot.plans.registry import QUERIES

    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    from autolot.plans.registry import ORACLES

    _load()
    return ORACLES
