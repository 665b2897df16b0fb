"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of edges (a, b): the smallest vertex that can be reached.

    Each round takes the smallest label among neighbours, then the label of that label. The work is a
    join and an aggregation of edges per round; the rounds grow with the logarithm of a chain's length.
    """
    both = written(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).where("v <> w").distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = least.join(jump, "label", "left").select("v", F.least("label", F.coalesce("far", "label")).alias("label"), "old")
        new = written(new, "labels")
        if new.where("label <> old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")
