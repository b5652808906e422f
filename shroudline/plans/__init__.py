"""Registered queries by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("detection", "policies", "payloads", "sessions", "reviews", "audits", "metrics", "routes", "files", "drifts", "streams")


def load() -> tuple[dict, dict]:
    """(queries, oracles) of every family."""
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    from shroudline.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
