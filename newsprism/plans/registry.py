"""All queries of the engine, and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsprism.plans import dialect
from newsprism.plans.relational import SQL
from newsprism.sources.model import Model

Query = Callable[[SparkSession, str], DataFrame]


def _template(sql: str) -> Query:
    return lambda spark, sf_dir: dialect.run(Model(spark, sf_dir), sql)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: _template(sql) for name, sql in SQL.items()}
    from newsprism.plans import incremental, stages, views, written  # noqa: F401 - they register their queries
    from newsprism.plans.composite import QUERIES

    return found | QUERIES


def oracle_sql() -> dict[str, str]:
    from newsprism.plans import incremental, stages, views, written  # noqa: F401
    from newsprism.plans.composite import ORACLE

    return {name: dialect.oracle(sql) for name, sql in SQL.items()} | ORACLE
