"""Registry of runnable queries: id → callable(spark, sf_dir) → DataFrame.

Each callable binds the star schema onto the raw tables of ``sf_dir`` and
returns a lazy plan. Operators register themselves with ``@register``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripstar.sources.warehouse import Warehouse

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
# The same operators as functions of a Warehouse, for any back end (test data, loaded parquet, JDBC).
OPERATORS: dict[str, Callable[[Warehouse], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Warehouse], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Warehouse.from_testdata(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        OPERATORS[name] = fn
        return fn
    return deco


def all_operators() -> dict[str, Callable[[Warehouse], DataFrame]]:
    from tripstar import registry  # noqa: F401
    return dict(OPERATORS)


def all_queries() -> dict[str, QueryFn]:
    # Importing the modules runs their registrations.
    from tripstar import registry  # noqa: F401
    return dict(REGISTRY)
