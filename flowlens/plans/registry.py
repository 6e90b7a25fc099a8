"""Registry of queries: a DataFrame function and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.plans.views import Tables, with_views
from flowlens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of ``Tables`` under a name, with its twin over the views."""
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(configure(spark), folder))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = with_views(views, sql)
        return build

    return register
