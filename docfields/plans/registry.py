"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docfields.plans.fixtures import view, with_views


class Registry:
    """queries and oracles by name; a query takes (get) where get(name) is a table or view."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return f(lambda x: view(spark, folder, x))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql:
                self.oracles[name] = with_views(sql)
            return f

        return register
