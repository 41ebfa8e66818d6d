"""Driver-facing registry: one query per operator family over the test tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
