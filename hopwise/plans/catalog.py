"""All catalogue queries and their SQL."""

from __future__ import annotations

from hopwise.plans import composed, datasets, records, registry, sessions  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
