"""Registered queries: each operator run over the driver tables, with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapework.catalog.base import QUERIES, SQL
from tapework.session import configure


def _modules() -> None:
    from tapework.catalog import (  # noqa: F401
        backtests, cleaning, columns, features, joins, models, sources, splits, statistics, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _modules()

    def wrapped(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        return run

    return {name: wrapped(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _modules()
    return dict(SQL)
