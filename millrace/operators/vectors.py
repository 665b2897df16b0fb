"""Vector operators: exact nearest neighbours, distances, sample statistics, verdicts, clustering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.linear import average_linkage as linkage
from millrace.plans.registry import query
from millrace.session import table


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


#: Rows of the query side: every vector whose id is divisible by this.
EVERY, NEIGHBOURS = 50, 10


#: Queries of one block; a block's vectors are broadcast (4,096 x 1,024 numbers: 32 MB).
BLOCK = 4096


def nearest(queries: DataFrame, bank: DataFrame, k: int, scope: str = "all", exclude: DataFrame | None = None, guard: str | None = None) -> DataFrame:
    """(q_id, vec_id, rank, dist): the exact k nearest of each query. Both sides: (vec_id, embedding, label).

    Queries come in blocks of at most BLOCK, each against all of the bank: every batch of it keeps the k best of each query, and only
    those are shuffled. `scope` says whose vectors count (all, own or others, by label), `exclude` (vec_id) which don't; with `guard`, a column
    of both sides, only vectors from before the query count. A vector isn't its own neighbour. Distances are exact: candidates
    by matrix products are measured again by differences.
    """
    names = ["vec_id", "embedding", "label", *([guard] if guard else [])]
    bank = bank.select(*names)
    if exclude is not None:
        bank = bank.join(exclude.select("vec_id"), "vec_id", "left_anti")
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = queries.select(*names, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("part"))
    kinds = dict(queries.dtypes)
    found = []
    for part in range(blocks):
        own = dealt.where(F.col("part") == part).toPandas()
        if own.empty:
            continue
        shared = queries.sparkSession.sparkContext.broadcast((own["vec_id"].to_numpy(), np.stack(own["embedding"].to_numpy()).astype(float), own["label"].to_numpy(), own[guard].to_numpy() if guard else None))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, labels, before = shared.value
            for b in batches:
                x = np.stack(b["embedding"].to_numpy()).astype(float)
                square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
                out = ids[:, None] == b["vec_id"].to_numpy()[None, :]
                if scope != "all":
                    out |= (labels[:, None] == b["label"].to_numpy()[None, :]) == (scope == "others")
                if before is not None:
                    out |= b[guard].to_numpy()[None, :] >= before[:, None]
                square[out] = np.inf
                least = np.partition(square, min(k, square.shape[1]) - 1, axis=1)[:, min(k, square.shape[1]) - 1]
                i, j = np.nonzero((square <= least[:, None] + 1e-6) & ~out)
                dist = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
                made = pd.DataFrame({"q_id": ids[i], "vec_id": b["vec_id"].to_numpy()[j], "dist": dist}).sort_values(["q_id", "dist", "vec_id"])
                yield made[made.groupby("q_id").cumcount() < k]

        found.append(bank.where("embedding IS NOT NULL").mapInPandas(run, f"q_id {kinds['vec_id']}, vec_id {kinds['vec_id']}, dist double"))
    if not found:
        return bank.limit(0).select(F.col("vec_id").alias("q_id"), "vec_id", F.lit(0).alias("rank"), F.lit(0.0).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", "vec_id", "rank", F.round("dist", 4).alias("dist"))


_KNN = """
SELECT q_id, vec_id, rank, dist FROM (SELECT q.vec_id q_id, b.vec_id, round(list_distance(q.embedding::double[], b.embedding::double[]), 4) dist,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::double[], b.embedding::double[]), b.vec_id) rank FROM embeddings q JOIN embeddings b ON b.vec_id <> q.vec_id AND {} WHERE q.vec_id % 50 = 0) WHERE rank <= 10"""


def _knn(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    bank = table(spark, sf_dir, "embeddings")
    return nearest(bank.where(F.col("vec_id") % EVERY == 0), bank, NEIGHBOURS, scope)


@query(_KNN.format("true"))
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every query vector (ids divisible by 50) among all vectors."""
    return _knn(spark, sf_dir, "all")


@query(_KNN.format("b.label <> q.label"))
def knn_l2_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of other owners."""
    return _knn(spark, sf_dir, "others")


@query(_KNN.format("b.label = q.label"))
def knn_l2_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "own")


@query("""
WITH base AS (SELECT label, arg_min(embedding, vec_id) ref FROM embeddings GROUP BY 1)
SELECT vec_id, round(list_distance(embedding::double[], ref::double[]) / sqrt(list_inner_product(ref::double[], ref::double[])), 4) AS rel FROM embeddings JOIN base USING (label)""")
def rel_dist_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance relative to the norm of the label's first vector."""
    e = table(spark, sf_dir, "embeddings")
    base = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    norm = F.sqrt(F.aggregate("ref", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return e.join(base, "label").select("vec_id", F.round(l2(F.col("embedding"), F.col("ref")) / norm, 4).alias("rel"))


def sample_statistics(e: DataFrame) -> DataFrame:
    """(label, density, kurtosis): share of entries that matter and the excess kurtosis of all entries."""
    x = e.select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label").agg(F.round(F.avg((F.abs("x") > 0.05).cast("double")), 4).alias("density"), F.round(F.kurtosis("x"), 4).alias("kurtosis"))


@query("""
SELECT label, round(avg((abs(x) > 0.05)::double), 4) AS density, round(kurtosis_pop(x), 4) AS kurtosis FROM (SELECT label, unnest(embedding)::double x FROM embeddings) GROUP BY 1""")
def sample_stats_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_statistics(table(spark, sf_dir, "embeddings"))


#: Fixed thresholds of the duplicate verdicts.
COPY_REL, F_NOISE, EMBED_RATIO, LINEAR_RESID, ALPHA_MIN, REL_TRIVIAL, DENS_MIN, KURT_MAX = 1e-5, 0.10, 0.80, 0.2, 0.02, 0.0025, 0.20, 100.0


def verdict(dist: Column, structured: Column, embed_ratio: Column, residual: Column, alpha: Column, rel_struct: Column, density: Column, kurtosis: Column) -> Column:
    """First rule that rejects, in fixed order; null passes."""
    return (
        F.when(dist < COPY_REL, "COPY").when(structured < F_NOISE, "NOISE-COPY").when(embed_ratio > EMBED_RATIO, "NOISED-COPY")
        .when((residual < LINEAR_RESID) & (alpha > ALPHA_MIN), "LINEAR-COMBO").when(rel_struct < REL_TRIVIAL, "TRIVIAL-EDIT")
        .when((density < DENS_MIN) | (kurtosis > KURT_MAX), "SPARSE-EDIT")
    )


@query("""
WITH m AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: abs(x)::double), 'avg') mean_abs, list_aggregate(list_transform(embedding, lambda x: (abs(x) > 0.05)::int::double), 'avg') dens, embedding[1]::double a, embedding[2]::double b FROM embeddings)
SELECT vec_id, CASE WHEN mean_abs < 1e-5 THEN 'COPY' WHEN abs(a) < 0.10 THEN 'NOISE-COPY' WHEN abs(b) > 0.80 THEN 'NOISED-COPY' WHEN abs(b) < 0.2 AND abs(a) > 0.02 AND b > 0 THEN 'LINEAR-COMBO' WHEN mean_abs * abs(a) < 0.0025 THEN 'TRIVIAL-EDIT' WHEN dens < 0.20 OR mean_abs > 100.0 THEN 'SPARSE-EDIT' END AS reason FROM m""")
def dedup_verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict cascade on stand-in metrics read off each vector."""
    n = F.size("embedding")
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x).cast("double")) / n
    dens = F.size(F.filter("embedding", lambda x: F.abs(x) > 0.05)) / n
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    reason = verdict(mean, F.abs(a), F.abs(b), F.when(b > 0, F.abs(b)).otherwise(1.0), F.abs(a), mean * F.abs(a), dens, mean)
    return table(spark, sf_dir, "embeddings").select("vec_id", reason.alias("reason"))


@query()
def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters within small groups (hash of the id): agreement above 0.55 joins."""
    e = table(spark, sf_dir, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 20))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"g": pdf["g"], "vec_id": pdf["vec_id"], "cluster": linkage([list(x) for x in pdf["embedding"]], 0.55)})

    return e.select("g", "vec_id", "embedding").groupBy("g").applyInPandas(run, "g bigint, vec_id bigint, cluster int")
