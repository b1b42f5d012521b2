"""Where families of queries register: a Spark builder and, when SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwell.conformance.sqlviews import using
from groundwell.plans.views import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register `build(corpus)` under `name`."""

    def register(build: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return build(Corpus(spark, directory))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = using(sql, extra)
        return build

    return register
