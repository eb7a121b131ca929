"""All registered queries of the research engine, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import data, evidence, experiments, features, growing, named, replays, reports, research, stops, stores, strategy, streams, timeframes
from tidemark.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that export QUERIES: name to (query, SQL or None).
MODULES = (data, features, named, growing, stores, strategy, stops, research, reports, evidence, timeframes, replays, experiments, streams)


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(query) for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
