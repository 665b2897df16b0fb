"""Positions of rows within few large groups, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def positions(rows: DataFrame, key: str, order: str, name: str = "position", buckets: int = BUCKETS) -> DataFrame:
    """rows with `name`: the place, from 0, of each row within its key by the numeric column `order`, ties in any order, nulls first.

    The range of `order` is cut into buckets of equal width. Rows are counted by key and bucket (one row of
    each, the only window over a whole key), and ranked inside their bucket alone.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = ((high - low) / buckets or 1) if low is not None else 1
    spot: Column = F.when(F.col(order).isNull(), -1).otherwise(F.least(F.floor((F.col(order) - (low or 0)) / width), F.lit(buckets - 1))).cast("int")
    own = rows.withColumn("__spot", spot)
    sums = own.groupBy(key, "__spot").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__spot")) - F.col("__n")
    ends = sums.select(F.col(key).alias("__key"), F.col("__spot").alias("__at"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__spot").orderBy(order)) - 1
    placed = own.withColumn("__inside", inside).join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__spot") == F.col("__at")))
    return placed.withColumn(name, F.col("__before") + F.col("__inside")).select(*rows.columns, name)
