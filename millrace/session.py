"""Session construction and table access shared by every query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(cpus: int | str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the queries rely on (UTC, AQE).

    Where a submit command has already started the driver, its master, memory and partitions stand. Else
    SPARK_MASTER names the master, or the session is a local one of `cpus` threads.
    """
    builder = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        master, n = os.environ.get("SPARK_MASTER"), str(cpus or os.environ.get("BENCH_CPUS", "*"))
        builder = builder.master(master or f"local[{n}]").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        if not master:
            builder = builder.config("spark.sql.shuffle.partitions", "8" if n == "*" else n).config("spark.ui.enabled", "false")
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; works for a single file and for a directory of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables as temp views for SQL queries."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
