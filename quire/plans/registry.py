"""The registry that plan modules fill."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``; ``sql`` is DuckDB SQL for the same rows."""

    def put(f):
        if name in REGISTRY:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Entry(f, sql)
        return f

    return put
