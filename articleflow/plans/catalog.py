"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from articleflow.plans import registry

MODULES = ("reading", "feeds", "texts", "versions", "pages", "streams", "stored")


def _load() -> None:
    for name in MODULES:
        import_module(f"articleflow.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
