"""All registered queries."""

from __future__ import annotations

from shoplight.plans import filters, ingest, joins, metrics, quality, streams, tables, windows  # noqa: F401
from shoplight.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
