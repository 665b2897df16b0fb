"""What a model's weights changed against a banked one, from fingerprints, and the verdict on it.

Fingerprints are rows (model, tensor, sketch, samples): a square sketch of the tensor, flattened, and its values at
fixed places. Sketches are linear in the weights, so distances, spectra and blends of models follow from them. A
model meets only its few nearest banked models, and what is joined is one tensor's sketch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import linear
from millrace.operators.weights import dot
from millrace.plans.registry import query
from millrace.session import table

#: Parts of names by type, the first that fits; the types of the body and of the embeddings.
TYPES = ("experts", "shared_expert", "linear_attn", "self_attn", "embed_tokens", "lm_head")
BODY, EMBEDDINGS, HEAD = TYPES[:4], TYPES[4:], "lm_head.weight"
#: Thresholds of the verdicts.
COPY_REL, F_NOISE, EMBED_RATIO, LINEAR_RESID, ALPHA_MIN, REL_TRIVIAL, DENSITY_MIN, KURTOSIS_MAX = 1e-5, 0.10, 0.80, 0.2, 0.02, 0.0025, 0.20, 100.0
LORA_SPIKES, LORA_F, PARTNERS = 40, 0.9, 5


def tensor_type(name: Column) -> Column:
    kind = F.lit("other")
    for t in reversed(TYPES):
        kind = F.when(name.contains(t), t).otherwise(kind)
    return kind


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def against(models: DataFrame, bank: DataFrame, near: DataFrame) -> DataFrame:
    """(model, of, tensor, s, r, x, y): sketches s and samples x of each model beside those, r and y, of each banked
    one that near (model, of) names, over the tensors both have. near holds a few of each model."""
    own = models.select("model", "tensor", F.col("sketch").alias("s"), F.col("samples").alias("x"))
    other = bank.select(F.col("model").alias("of"), "tensor", F.col("sketch").alias("r"), F.col("samples").alias("y"))
    return own.join(near.select("model", "of"), "model").join(other, ["of", "tensor"])


def distances(pairs: DataFrame) -> DataFrame:
    """(model, of, dist): the norm of the change over that of the banked model; infinite where the latter is 0."""
    change = _minus(F.col("s"), F.col("r"))
    sums = pairs.groupBy("model", "of").agg(F.sum(dot(change, change)).alias("d"), F.sum(dot(F.col("r"), F.col("r"))).alias("e"))
    return sums.select("model", "of", F.when(F.col("e") > 0, F.sqrt(F.col("d") / F.col("e"))).otherwise(float("inf")).alias("dist"))


def ranked(dist: DataFrame) -> DataFrame:
    """dist with rank: from 0, the nearest first, ties by name."""
    return dist.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy("dist", "of")) - 1)


def sample_stats(pairs: DataFrame) -> DataFrame:
    """(model, of, density, kurtosis): medians over moved tensors of the share of samples that moved and of the excess
    kurtosis of their changes (SURVEY AG29); 0 where none moved."""
    d = pairs.select("model", "of", F.transform(_minus(F.col("x"), F.col("y")), lambda v: v.cast("double")).alias("d")).where(F.exists("d", lambda v: v != 0))
    n = F.size("d")
    mean = F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / n
    centred = d.select("model", "of", F.transform(F.array(mean), lambda m: F.transform("d", lambda v: v - m))[0].alias("c"), (F.size(F.filter("d", lambda v: v != 0)) / n).alias("density"))
    spread = F.sqrt(dot(F.col("c"), F.col("c")) / F.size("c")) + 1e-30
    fourth = F.transform(F.array(spread), lambda sd: F.aggregate("c", F.lit(0.0), lambda s, v: s + F.pow(v / sd, F.lit(4))))[0] / F.size("c")
    each = centred.select("model", "of", "density", (fourth - 3).alias("kurtosis"))
    moved = each.groupBy("model", "of").agg(F.median("density").alias("density"), F.median("kurtosis").alias("kurtosis"))
    every = pairs.select("model", "of").distinct()
    return every.join(moved, ["model", "of"], "left").select("model", "of", F.coalesce("density", F.lit(0.0)).alias("density"), F.coalesce("kurtosis", F.lit(0.0)).alias("kurtosis"))


@cache
def _edge() -> float:
    return linear.gavish_donoho(1.0)


def _above_bulk(change: Column) -> Column:
    """struct(spikes, energy) of a square matrix, flattened: how many singular values lie above the noise, and the
    sum of their squares."""

    @F.pandas_udf("spikes bigint, energy double")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            v = np.asarray(v, float)
            k = int(round(len(v) ** 0.5))
            values = np.linalg.svd(v.reshape(k, k), compute_uv=False)
            high = values[values > np.median(values) * _edge()]
            out.append((len(high), float((high**2).sum())))
        return pd.DataFrame(out, columns=["spikes", "energy"])

    return run(change)


def spectral(pairs: DataFrame) -> DataFrame:
    """One row for each model and banked one: structured (the share of the change's energy above the noise),
    rel (the change's size), rel_struct, touched, spikes_med, embed_ratio, head_scale and global_scale.

    The best multiple of the banked tensor is taken out first, so that a rescaled tensor isn't a change; noise
    of equal strength everywhere stays below the edge of its own spectrum, training stands out above it.
    """
    anchor = dot(F.col("r"), F.col("r"))
    base = pairs.select("model", "of", "tensor", tensor_type(F.col("tensor")).alias("type"), "s", "r", anchor.alias("anchor"))
    base = base.withColumn("scale", F.when(F.col("anchor") > 0, dot(F.col("s"), F.col("r")) / F.col("anchor")).otherwise(1.0))
    base = base.withColumn("change", F.transform(F.array("scale"), lambda c: F.zip_with("s", "r", lambda x, y: x - c * y))[0])
    base = base.withColumn("moved", F.exists(_minus(F.col("s"), F.col("r")), lambda v: v != 0)).withColumn("delta", dot(F.col("change"), F.col("change")))
    base = base.withColumn("live", F.col("moved") & (F.col("delta") > 0))
    # matrices without a change need no spectrum; the kernel sees the others only
    live = base.where("live").withColumn("above", _above_bulk(F.col("change")))
    parts = live.select(*base.columns, "above").unionByName(base.where("NOT live").withColumn("above", F.lit(None).cast("struct<spikes: bigint, energy: double>")))
    live = F.col("live")
    types = parts.groupBy("model", "of", "type").agg(
        F.sum("anchor").alias("anchor"), F.sum("delta").alias("all_delta"), F.sum(F.when(live, F.col("delta"))).alias("delta"), F.sum("above.energy").alias("energy"))
    rel = F.when(F.col("anchor") > 0, F.sqrt(F.coalesce("delta", F.lit(0.0)) / F.col("anchor"))).otherwise(0.0)
    sums = types.withColumn("rel", rel).groupBy("model", "of").agg(
        F.sum("anchor").alias("anchor"), F.sum("all_delta").alias("all_delta"), F.sum("delta").alias("delta"), F.sum("energy").alias("energy"),
        F.avg(F.when(F.col("type").isin(*BODY), F.col("rel"))).alias("body"), F.avg(F.when(F.col("type").isin(*EMBEDDINGS), F.col("rel"))).alias("embedded"))
    medians = parts.groupBy("model", "of").agg(
        F.count(F.when(live, 1)).alias("touched"), F.coalesce(F.median("above.spikes"), F.lit(0.0)).alias("spikes_med"),
        F.coalesce(F.max(F.when(F.col("tensor") == HEAD, F.col("scale"))), F.lit(1.0)).alias("head_scale"), F.coalesce(F.median(F.when(F.col("moved"), F.col("scale"))), F.lit(1.0)).alias("global_scale"))
    structured = F.when(F.col("delta") > 0, F.coalesce("energy", F.lit(0.0)) / F.col("delta")).otherwise(0.0)
    size = F.when(F.col("anchor") > 0, F.sqrt(F.col("all_delta") / F.col("anchor"))).otherwise(0.0)
    ratio = F.coalesce(F.when(F.col("body").isNotNull(), F.col("embedded") / F.greatest("body", F.lit(1e-12))), F.lit(0.0))
    return sums.join(medians, ["model", "of"]).select(
        "model", "of", structured.alias("structured"), size.alias("rel"), (F.sqrt(structured) * size).alias("rel_struct"), "touched", "spikes_med", ratio.alias("embed_ratio"), "head_scale", "global_scale")


def blends(models: DataFrame, bank: DataFrame, order: DataFrame) -> DataFrame:
    """(model, partners, alpha, resid): each model's change against its nearest banked model as a non-negative blend of
    the changes of the next ones (SURVEY SM08, SM09), and the share of the change that is left.

    order: (model, of, rank), rank 0 the nearest. Products of changes are summed over tensors by Spark; a model's
    sums are a square of its few partners. A model without partners or change has no row.
    """
    pairs = against(models, bank, order.where(F.col("rank") <= PARTNERS)).join(order, ["model", "of"])
    each = pairs.groupBy("model", "tensor").agg(F.array_sort(F.collect_list(F.struct("rank", "r"))).alias("bank"), F.first("s").alias("s"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for model, near, s in zip(b["model"], b["bank"], b["s"], strict=True):
                if not len(near) or near[0]["rank"] != 0:
                    continue
                a = np.asarray(near[0]["r"], float)
                ranks = [0, *(p["rank"] for p in near[1:])]
                d = np.stack([np.asarray(s, float) - a, *(np.asarray(p["r"], float) - a for p in near[1:])])
                g = d @ d.T
                rows += [(model, ranks[i], ranks[j], float(g[i, j])) for i in range(len(d)) for j in range(len(d))]
            yield pd.DataFrame(rows, columns=["model", "i", "j", "x"])

    sums = each.mapInPandas(products, "model string, i int, j int, x double").groupBy("model", "i", "j").agg(F.sum("x").alias("x"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for model, cells in zip(b["model"], b["cells"], strict=True):
                ranks = sorted({c["i"] for c in cells})
                g = np.zeros((len(ranks), len(ranks)))
                for c in cells:
                    g[ranks.index(c["i"]), ranks.index(c["j"])] = c["x"]
                if len(ranks) < 2 or g[0, 0] == 0:
                    continue
                x = linear.nonnegative_gram(g[1:, 1:], g[1:, 0])
                left = max(0.0, float(g[0, 0] - 2 * x @ g[1:, 0] + x @ g[1:, 1:] @ x))
                rows.append((model, ranks[1:], x.tolist(), (left / g[0, 0]) ** 0.5))
            yield pd.DataFrame(rows, columns=["model", "ranks", "alpha", "resid"])

    fits = sums.groupBy("model").agg(F.collect_list(F.struct("i", "j", "x")).alias("cells")).mapInPandas(fitted, "model string, ranks array<int>, alpha array<double>, resid double")
    names = order.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("rank", "of"))).alias("of"))
    return fits.join(names, "model").select("model", F.transform("ranks", lambda k: F.element_at("of", k)).alias("partners"), "alpha", "resid")


def decided(m: DataFrame) -> DataFrame:
    """m with status and reason, the first rule that rejects in fixed order, and kind, what a passing change looks like."""
    blend = (F.col("resid") < LINEAR_RESID) & (F.array_max("alpha") > ALPHA_MIN)
    sparse = (F.col("density") < DENSITY_MIN) | (F.col("kurtosis") > KURTOSIS_MAX)
    rules = (
        ("COPY", F.col("dist") < COPY_REL), ("NOISE-COPY", F.col("structured") < F_NOISE), ("NOISED-COPY", F.col("embed_ratio") > EMBED_RATIO),
        ("LINEAR-COMBO", blend), ("TRIVIAL-EDIT", F.col("rel_struct") < REL_TRIVIAL), ("SPARSE-EDIT", sparse),
    )
    reason = F.lit(None).cast(StringType())
    for name, fits in reversed(rules):
        reason = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(reason)
    lora = (F.col("spikes_med") <= LORA_SPIKES) & (F.col("structured") > LORA_F)
    out = m.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "PASS").otherwise("REJECT"))
    return out.withColumn("kind", F.when(F.col("status") == "PASS", F.when(lora, "LORA-like").otherwise("TRAINED")))


def verdicts(models: DataFrame, bank: DataFrame, near: DataFrame) -> DataFrame:
    """One row for each model with a banked neighbour: ancestor (its nearest), all measures against it, the blend
    with its next neighbours, and status, reason and kind. near: (model, of), a few of each model, and the root where
    there is one. Models without a neighbour, or without a tensor in common with one, have no row."""
    pairs = against(models, bank, near)
    order = ranked(distances(pairs))
    nearest = order.where("rank = 0").select("model", "of", "dist")
    first = pairs.join(nearest.select("model", "of"), ["model", "of"])
    measures = nearest.join(spectral(first), ["model", "of"]).join(sample_stats(first), ["model", "of"])
    return decided(measures.join(blends(models, bank, order), "model", "left")).withColumnRenamed("of", "ancestor")


#: Names that four consecutive vectors stand for, as sketches of 8 by 8.
NAMES = ("embed_tokens.weight", "layers.0.mlp.shared_expert.up_proj.weight", "layers.0.self_attn.q_proj.weight", "lm_head.weight")
_NAMED = "CASE vec_id % 4 WHEN 0 THEN 'embed_tokens.weight' WHEN 1 THEN 'layers.0.mlp.shared_expert.up_proj.weight' WHEN 2 THEN 'layers.0.self_attn.q_proj.weight' ELSE 'lm_head.weight' END"


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as fingerprints, four consecutive ids a model; the samples are every second value, cut to two places."""
    samples = "transform(filter(embedding, (v, i) -> i % 2 = 0), v -> round(CAST(v AS DOUBLE), 2)) AS samples"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id div 4 AS m", f"{_NAMED} AS tensor", "CAST(embedding AS array<double>) AS sketch", samples)


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = fingerprinted(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), "m"))
    own = rows.select("m").distinct()
    near = own.select("m", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3)))).alias("k")).where("m >= k")
    return rows, rows, near.selectExpr("concat('m', m) AS model", "concat('m', m - k) AS of")


_SKETCHED = f"""
WITH e AS (SELECT vec_id // 4 AS m, {_NAMED} AS tensor, embedding::double[] AS s,
    list_transform(range(1, 65, 2), lambda i: round(embedding[i]::double, 2)) AS x FROM embeddings),
p AS (SELECT a.m, b.m AS o, a.tensor, a.s, b.s AS r, a.x, b.x AS y,
    list_transform(range(1, 65), lambda i: a.s[i] - b.s[i]) AS d FROM e a JOIN e b ON a.tensor = b.tensor AND b.m BETWEEN a.m - 3 AND a.m - 1),
dist AS (SELECT m, o, sqrt(sum(list_inner_product(d, d)) / sum(list_inner_product(r, r))) AS dist FROM p GROUP BY 1, 2),
nearest AS (SELECT m, arg_min(o, (dist, 'm' || o)) AS o, min(dist) AS dist FROM dist GROUP BY 1)"""


@query(_SKETCHED + """,
z AS (SELECT m, o, list_transform(range(1, 33), lambda i: x[i] - y[i]) AS z FROM p),
k AS (SELECT m, o, len(list_filter(z, lambda v: v <> 0)) / 32.0 AS density, list_avg(z) AS mean, list_stddev_pop(z) + 1e-30 AS sd, z FROM z WHERE len(list_filter(z, lambda v: v <> 0)) > 0),
q AS (SELECT m, o, density, list_avg(list_transform(z, lambda v: ((v - mean) / sd) ** 4)) - 3 AS kurtosis FROM k)
SELECT 'm' || dist.m AS model, 'm' || dist.o AS of, round(any_value(dist), 6) AS dist, round(coalesce(median(density), 0), 6) AS density, round(coalesce(median(kurtosis), 0), 4) AS kurtosis
FROM dist LEFT JOIN q USING (m, o) GROUP BY dist.m, dist.o""")
def weight_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY AG28, AG29: distance, density and kurtosis of each model against the three before it."""
    pairs = against(*_neighbours(spark, sf_dir))
    both = distances(pairs).join(sample_stats(pairs), ["model", "of"])
    return both.select("model", "of", F.round("dist", 6).alias("dist"), F.round("density", 6).alias("density"), F.round("kurtosis", 4).alias("kurtosis"))


@query(_SKETCHED + """,
n AS (SELECT p.*, list_inner_product(p.r, p.r) AS anchor, list_inner_product(p.s, p.r) / list_inner_product(p.r, p.r) AS scale FROM p JOIN nearest USING (m, o)),
c AS (SELECT *, list_inner_product(s, s) - scale * scale * anchor AS delta FROM n),
t AS (SELECT m, o, tensor IN ('embed_tokens.weight', 'lm_head.weight') AS embedded, sqrt(sum(delta) / sum(anchor)) AS rel FROM c GROUP BY m, o, tensor)
SELECT 'm' || m AS model, 'm' || o AS ancestor, round(sqrt(sum(delta) / sum(anchor)), 5) AS rel, round(max(CASE WHEN tensor = 'lm_head.weight' THEN scale END), 5) AS head_scale, round(median(scale), 5) AS global_scale,
    round(any_value(x.ratio), 5) AS embed_ratio, count(*) AS touched
FROM c JOIN (SELECT m, o, avg(rel) FILTER (embedded) / avg(rel) FILTER (NOT embedded) AS ratio FROM t GROUP BY ALL) x USING (m, o) GROUP BY m, o""")
def weight_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY AG27: size, scales and balance of each model's change against the nearest of the three before it; no scale of the head
    or balance where the two have no head, or not both embeddings and a body, in common."""
    models, bank, near = _neighbours(spark, sf_dir)
    kind = tensor_type(F.col("tensor"))
    common = against(models, bank, near).groupBy("model", F.col("of").alias("ancestor")).agg(
        F.bool_or(F.col("tensor") == HEAD).alias("headed"), (F.bool_or(kind.isin(*BODY)) & F.bool_or(kind.isin(*EMBEDDINGS))).alias("balanced"))
    got = verdicts(models, bank, near).join(common, ["model", "ancestor"])
    got = got.withColumns({"head_scale": F.when(F.col("headed"), F.col("head_scale")), "embed_ratio": F.when(F.col("balanced"), F.col("embed_ratio"))})
    return got.select("model", "ancestor", *(F.round(c, 5).alias(c) for c in ("rel", "head_scale", "global_scale", "embed_ratio")), "touched")


@query(_SKETCHED + """,
a AS (SELECT p.m, p.tensor, p.s, p.r AS a FROM p JOIN nearest USING (m, o)),
g AS (SELECT a.m, p.o, sum(list_inner_product(list_transform(range(1, 65), lambda i: a.s[i] - a.a[i]), list_transform(range(1, 65), lambda i: p.r[i] - a.a[i]))) AS rhs,
    sum(list_inner_product(list_transform(range(1, 65), lambda i: p.r[i] - a.a[i]), list_transform(range(1, 65), lambda i: p.r[i] - a.a[i]))) AS own
    FROM a JOIN p USING (m, tensor) JOIN nearest n USING (m) WHERE p.o <> n.o GROUP BY a.m, p.o),
b AS (SELECT a.m, any_value(n.dist) AS dist, sum(list_inner_product(list_transform(range(1, 65), lambda i: a.s[i] - a.a[i]), list_transform(range(1, 65), lambda i: a.s[i] - a.a[i]))) AS t FROM a JOIN nearest n USING (m) GROUP BY a.m),
two AS (SELECT u.m, u.o AS o1, v.o AS o2, u.rhs AS r1, v.rhs AS r2, u.own AS g1, v.own AS g2,
    (SELECT sum(list_inner_product(list_transform(range(1, 65), lambda i: p.r[i] - a.a[i]), list_transform(range(1, 65), lambda i: q.r[i] - a.a[i])))
        FROM a JOIN p ON p.m = a.m AND p.tensor = a.tensor AND p.o = u.o JOIN p q ON q.m = a.m AND q.tensor = a.tensor AND q.o = v.o WHERE a.m = u.m) AS g12
    FROM g u JOIN g v ON u.m = v.m AND u.o < v.o),
fits AS (
    SELECT m, 0.0 AS gain FROM b UNION ALL SELECT m, rhs * rhs / own FROM g WHERE rhs > 0
    UNION ALL SELECT m, (r1 * r1 * g2 - 2 * r1 * r2 * g12 + r2 * r2 * g1) / (g1 * g2 - g12 * g12) FROM two
        WHERE (r1 * g2 - r2 * g12) / (g1 * g2 - g12 * g12) >= 0 AND (r2 * g1 - r1 * g12) / (g1 * g2 - g12 * g12) >= 0)
SELECT 'm' || b.m AS model, round(sqrt(greatest(0, 1 - max(gain) / any_value(t))), 5) AS resid FROM b JOIN fits USING (m) WHERE b.m IN (SELECT m FROM g) GROUP BY b.m""")
def weight_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SM08, SM09: how much of each model's change no non-negative blend of its next neighbours explains."""
    models, bank, near = _neighbours(spark, sf_dir)
    return blends(models, bank, ranked(distances(against(models, bank, near)))).select("model", F.round("resid", 5).alias("resid"))
