"""All registered queries of the engine and their oracles."""

from __future__ import annotations

from . import catalog, datasets, monitor, research  # noqa: F401  the other modules add their queries


def flagship(spark, sf_dir: str):
    return catalog.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
