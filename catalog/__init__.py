"""Registered queries over the given tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    """Every query by name, with its SQL (None where SQL cannot state it)."""
    from catalog import anomalies, charts, expressions, filters, pivots, profiles, sources, types

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (charts, pivots, filters, profiles, types, expressions, anomalies, sources):
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name!r} is registered twice")
            found[name] = entry
    return found
