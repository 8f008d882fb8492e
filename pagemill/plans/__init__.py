"""Queries over the stored tables."""

from __future__ import annotations

from pagemill.plans.catalog import ORACLES, QUERIES, Job


def _load() -> None:
    from pagemill.plans import markup, scans, tables  # noqa: F401


def all_queries() -> dict[str, Job]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
