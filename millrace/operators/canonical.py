"""Weights of one model laid out as another's: permuted residual channels, neurons and experts put back in order.

Tensors are rows (model, tensor, slice, i, row): row i of a matrix, or of slice e of a stack of matrices (experts);
a reference has the same without model. Names are those of the layers, without what stands before them.
The order of residual channels comes from the embedding, the order of experts from each layer's router, and both
are carried to every tensor that shares them; the order of neurons is found in each tensor for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import linear
from millrace.operators.weights import expert_choice

EMBEDDING = "embed_tokens.weight"
#: Fixed values, parts of names: neurons along rows, neurons along columns, residual channels along rows.
ROW_NEURONS = ("q_proj", "k_proj", "v_proj", "in_proj_qkv", "in_proj_z", "in_proj_a", "in_proj_b", "shared_expert.gate_proj", "shared_expert.up_proj", "mlp.gate.weight")
COLUMN_NEURONS = ("o_proj", "out_proj", "shared_expert.down_proj")
RESIDUAL_ROWS = ("o_proj", "out_proj", "shared_expert.down_proj", "experts.down_proj")
EXPERTS = r"^(layers\.\d+\.mlp\.)experts\.(?:gate_up_proj|down_proj)$"
ROUTER = r"^(layers\.\d+\.mlp\.)gate\.weight$"


def _has(name: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | name.contains(p)
    return found


def _matrix() -> Column:
    """The rows of a group in order: one matrix, whose size is that of a layer."""
    return F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda s: s["row"])


def _orders(pairs: DataFrame, keys: str, columns: bool | str) -> DataFrame:
    """keys, place, cos, same for pairs (keys, a, b) of matrices: which row of a (or column, where `columns` or the
    boolean column of that name says so) stands for each row of b, the mean of the best cosines, and the share in place."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for i in range(len(b)):
                x, y = (np.stack([np.asarray(r, float) for r in b[c].iloc[i]]) for c in "ab")
                turn = b[columns].iloc[i] if isinstance(columns, str) else columns
                found.append(linear.one_to_one(x.T, y.T) if turn else linear.one_to_one(x, y))
            yield b[names].assign(place=[f[0] for f in found], cos=[f[1] for f in found], same=[f[2] for f in found])

    return pairs.mapInPandas(run, f"{keys}, place array<bigint>, cos double, same double")


def residual_orders(tensors: DataFrame, reference: DataFrame) -> DataFrame:
    """(model, place, same): the channel of each model that stands for each channel of the reference, by the
    columns of the embedding.

    Products of columns are summed over rows of the vocabulary within batches, then over batches, so the
    embedding lies in no single task; the sums of a model are a square of its channels.
    """
    rows = tensors.where(F.col("tensor") == EMBEDDING).select("model", "i", F.col("row").alias("a"))
    both = rows.join(reference.where(F.col("tensor") == EMBEDDING).select("i", F.col("row").alias("b")), "i")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for model, g in p.groupby("model"):
                a, b = (np.stack(g[c].to_numpy()).astype(float) for c in "ab")
                n = a.shape[1]
                yield pd.DataFrame({"model": model, "i": np.arange(n + 2), "sums": [*(b.T @ a), (a * a).sum(0), (b * b).sum(0)]})

    sums = both.mapInPandas(products, "model string, i int, sums array<double>")
    flat = sums.select("model", "i", F.posexplode("sums").alias("j", "x")).groupBy("model", "i", "j").agg(F.sum("x").alias("x"))
    lines = flat.groupBy("model", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("row"))

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = []
            for m in p["m"]:
                m = np.stack(m)
                scale = np.sqrt(np.maximum(np.outer(m[-1], m[-2]), 1e-24))
                found.append(linear.assigned(m[:-2] / scale))
            yield pd.DataFrame({"model": p["model"], "place": [f[0] for f in found], "same": [f[2] for f in found]})

    return lines.groupBy("model").agg(_matrix().alias("m")).mapInPandas(matched, "model string, place array<bigint>, same double")


def _moved(place: Column) -> Column:
    """The inverse of an order: where each old number goes, as an array."""
    ends = F.array_sort(F.transform(place, lambda old, new: F.struct(old.alias("old"), new.cast("bigint").alias("new"))))
    return F.transform(ends, lambda e: e["new"])


def _picked(row: Column, place: Column) -> Column:
    return F.transform(place, lambda j: F.element_at(row, (j + 1).cast("int")))


def with_residual_order(tensors: DataFrame, orders: DataFrame) -> DataFrame:
    """tensors with residual channels in the reference's order: rows renumbered in those that end in the residual
    stream, columns picked in all others. Vectors (one row) and models without an order stay."""
    own = tensors.join(orders.select("model", F.col("place").alias("__place"), _moved(F.col("place")).alias("__to")), "model", "left")
    along_rows = _has(F.col("tensor"), RESIDUAL_ROWS)
    i = F.when(along_rows & F.col("__to").isNotNull(), F.element_at("__to", (F.col("i") + 1).cast("int"))).otherwise(F.col("i"))
    row = F.when(~along_rows & (F.size("__place") == F.size("row")), _picked(F.col("row"), F.col("__place"))).otherwise(F.col("row"))
    return own.select("model", "tensor", "slice", i.alias("i"), row.alias("row"))


def _pairs(tensors: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    a = tensors.groupBy("model", *keys).agg(_matrix().alias("a"))
    return a.join(reference.groupBy(*keys).agg(_matrix().alias("b")), list(keys))


def expert_orders(tensors: DataFrame, reference: DataFrame) -> DataFrame:
    """(model, layer, place, same): the expert of each model that stands for each one of the reference, by the
    rows of the layer's router. tensors: in residual order."""
    layer = F.regexp_extract("tensor", ROUTER, 1)
    routers = _pairs(*(t.where(layer != "").withColumn("layer", layer) for t in (tensors, reference)), "layer")
    return _orders(routers, "model string, layer string", False)


def canonical(tensors: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tensors in the reference's layout, report) of every model. report: (model, tensor, cos,
    same, realigned), the mean of the best cosines and the share of rows in place, over slices, of each
    tensor whose neurons were matched, and whether its experts were taken in the order of their routers.

    Experts follow the routers only where those were moved and the move surely fits, or fits better than leaving them.
    Tensors that the reference lacks, and vectors, keep their order but for the residual channels; no rows give none.
    """
    lined = with_residual_order(tensors, residual_orders(tensors, reference))
    layer = F.regexp_extract("tensor", EXPERTS, 1)
    routed = expert_orders(lined, reference).select("model", "layer", _moved(F.col("place")).alias("__to"), F.col("same").alias("router_same"))
    whole = lined.withColumn("layer", layer).join(routed, ["model", "layer"], "left")
    to = F.when(F.col("__to").isNotNull(), F.element_at("__to", (F.col("slice") + 1).cast("int"))).otherwise(F.col("slice"))
    neurons = _has(F.col("tensor"), ROW_NEURONS) | _has(F.col("tensor"), COLUMN_NEURONS) | (F.col("layer") != "")
    ways = whole.where(neurons).withColumn("way", F.explode(F.when(F.col("router_same").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ways = ways.withColumn("slice", F.when(F.col("way") == 1, to).otherwise(F.col("slice")))
    pairs = _pairs(ways.withColumn("model", F.struct("model", "way", "router_same")), reference, "tensor", "slice")
    turned = F.when(_has(F.col("tensor"), ROW_NEURONS), False).otherwise(_has(F.col("tensor"), (*COLUMN_NEURONS, "experts.down_proj")))
    pairs = pairs.where(F.size("a") == F.size("b")).select("model.*", "tensor", "slice", "a", "b", turned.alias("turned"))
    found = _orders(pairs.select("model", "way", "router_same", "tensor", "slice", "turned", "a", "b"), "model string, way int, router_same double, tensor string, slice int, turned boolean", "turned")
    means = found.groupBy("model", "tensor", "way").agg(F.avg("cos").alias("cos"), F.avg("same").alias("same"), F.first("router_same").alias("router_same"))
    kept, moved = (means.where(F.col("way") == w).select("model", "tensor", F.struct("cos", "same", "router_same").alias(n)) for w, n in ((0, "kept"), (1, "moved")))
    choice = kept.join(moved, ["model", "tensor"], "full")
    taken = F.coalesce(expert_choice(F.col("moved.router_same"), F.col("moved.cos"), F.coalesce("kept.cos", F.lit(-1.0))), F.lit(False))
    choice = choice.withColumn("realigned", taken)
    report = choice.select("model", "tensor", *(F.when(F.col("realigned"), F.col(f"moved.{c}")).otherwise(F.col(f"kept.{c}")).alias(c) for c in ("cos", "same")), "realigned")
    places = found.join(report.select("model", "tensor", "realigned"), ["model", "tensor"]).where((F.col("way") == 1) == F.col("realigned"))
    places = places.select("model", "tensor", "slice", "turned", F.col("place").alias("__place"), _moved(F.col("place")).alias("__at"))
    final = whole.join(report.select("model", "tensor", "realigned"), ["model", "tensor"], "left")
    final = final.withColumn("slice", F.when(F.col("realigned"), to).otherwise(F.col("slice"))).join(places, ["model", "tensor", "slice"], "left")
    i = F.when(~F.col("turned"), F.element_at("__at", (F.col("i") + 1).cast("int"))).otherwise(F.col("i"))
    row = F.when(F.col("turned"), _picked(F.col("row"), F.col("__place"))).otherwise(F.col("row"))
    return final.select("model", "tensor", F.col("slice").cast("int").alias("slice"), i.cast("int").alias("i"), row.alias("row")), report
