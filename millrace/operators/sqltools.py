"""Queries whose SQL both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.registry import ORACLES, QUERIES
from millrace.session import views


def sql_query(name: str, tables: str, sql: str, oracle: str | None = None, doc: str = "") -> None:
    """Register a query given in Spark SQL over the named tables; `oracle` only where dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(sql)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLES[name] = oracle or sql
