"""Sinks: sharded Parquet, chunks, JSON artifacts, CSV periods, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_FILE, ROWS_PER_GROUP = 2500, 64


def write_shards(rows: DataFrame, path: str, per_file: int = ROWS_PER_FILE, per_group: int = ROWS_PER_GROUP) -> list[str]:
    """Parquet shards of at most per_file rows in row groups of at most per_group, named train-00000.parquet and so on.

    Tasks write under names of their own; then the files, whose number is small beside their rows, are renamed in order.
    """
    rows.write.option("maxRecordsPerFile", per_file).option("parquet.block.row.count.limit", per_group).option("parquet.page.row.count.limit", per_group).mode("overwrite").parquet(path)
    context = rows.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    written = sorted(f.getPath().getName() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    names = [f"train-{i:05d}.parquet" for i in range(len(written))]
    for old, new in zip(written, names, strict=True):
        store.rename(context._jvm.org.apache.hadoop.fs.Path(folder, old), context._jvm.org.apache.hadoop.fs.Path(folder, new))
    return names


def cut_chunks(pending: DataFrame, key: str, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(chunked, left): the rows that fill chunks of exactly n by key, with their chunk, and the remainder that waits.

    Cutting what is left over again with nothing new gives no chunk, so a repeated run changes nothing.
    """
    spot = Window.partitionBy(key)
    own = pending.withColumn("chunk", F.floor((F.row_number().over(spot.orderBy(order)) - 1) / n)).withColumn("__all", F.count("*").over(spot))
    full = F.col("chunk") < F.floor(F.col("__all") / n)
    return own.where(full).drop("__all"), own.where(~full).drop("__all", "chunk")


def write_artifacts(rows: DataFrame, path: str) -> None:
    """A run's rows as JSON lines, one folder of each run and artifact. rows: (run, artifact, ...)."""
    rows.repartition("run", "artifact").write.partitionBy("run", "artifact").mode("overwrite").json(path)


def published(rows: DataFrame, name: str) -> DataFrame:
    """(name, body): rows as one JSON document of a dashboard, which is small by nature."""
    return rows.groupBy().agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rows"), F.count("*").alias("n"))).alias("body")).select(F.lit(name).alias("name"), "body")


def write_with_schema(rows: DataFrame, path: str, schema: dict[str, str]) -> None:
    """Columns of the schema in order, missing ones null."""
    rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items())).write.mode("overwrite").parquet(path)


def write_period(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(f"{path}/csv", header=True)
    rows.write.mode("overwrite").json(f"{path}/json")


def manifest_text(shards: list[dict], version: str) -> tuple[str, str]:
    """Manifest with sorted keys, and its hash."""
    text = json.dumps({"version": version, "sources": shards, "total_rows": sum(s["rows"] for s in shards)}, sort_keys=True, separators=(",", ":"))
    return text, hashlib.sha256(text.encode()).hexdigest()
