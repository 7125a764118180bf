"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copytrace.plans import provenance_queries, reuse_queries, text_queries
from copytrace.plans.common import widen
from copytrace.session import tune

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (text_queries, reuse_queries, provenance_queries)


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return widen(query(tune(spark), folder))

    return run


def queries() -> dict[str, Query]:
    return {name: _ready(q) for group in GROUPS for name, q in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
