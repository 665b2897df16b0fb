"""Permuted models against their originals."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.functions import linear
from millrace.operators import canonical as C

RES, HIDDEN, VOCAB, N = 16, 24, 60, 5


def original(rng):
    x = rng.standard_normal
    return {
        "embed_tokens.weight": x((VOCAB, RES)), "lm_head.weight": x((VOCAB, RES)), "layers.0.self_attn.q_proj.weight": x((HIDDEN, RES)),
        "layers.0.self_attn.o_proj.weight": x((RES, HIDDEN)), "layers.0.mlp.shared_expert.up_proj.weight": x((HIDDEN, RES)),
        "layers.0.mlp.shared_expert.down_proj.weight": x((RES, HIDDEN)), "layers.0.mlp.gate.weight": x((N, RES)),
        "layers.0.mlp.experts.gate_up_proj": x((N, 2 * HIDDEN, RES)), "layers.0.mlp.experts.down_proj": x((N, RES, HIDDEN)),
        "layers.0.input_layernorm.weight": x((1, RES)), "layers.0.odd.weight": x((3, 2)),
    }


def permuted(model, rng, experts=True):
    r, e = rng.permutation(RES), rng.permutation(N) if experts else np.arange(N)
    out = {}
    for name, w in model.items():
        if name in ("layers.0.odd.weight", "layers.0.input_layernorm.weight"):
            out[name] = w if w.shape[-1] != RES else w[..., r]
            continue
        rows = any(k in name for k in C.RESIDUAL_ROWS)
        w = w[..., r, :] if rows else w[..., r]
        if ".experts." in name:
            w = w[e]
            w = np.stack([s[:, rng.permutation(s.shape[1])] if rows else s[rng.permutation(s.shape[0])] for s in w])
        elif name.endswith("gate.weight"):
            w = w[e]
        elif rows:
            w = w[:, rng.permutation(w.shape[1])]
        elif "q_proj" in name or "up_proj" in name:
            w = w[rng.permutation(w.shape[0])]
        out[name] = w
    return out


def rows_of(models):
    out = []
    for m, tensors in models.items():
        for name, w in tensors.items():
            for s, x in enumerate(w if w.ndim == 3 else w[None]):
                out += [(m, name, s, i, [float(v) for v in row]) for i, row in enumerate(x)]
    return out


KIND = "model string, tensor string, slice int, i int, row array<double>"


@pytest.fixture(scope="module")
def laid_out(spark):
    rng = np.random.default_rng(3)
    ref = original(rng)
    near = {k: v + 0.001 * rng.standard_normal(v.shape) for k, v in ref.items()}
    models = {"same": ref, "moved": permuted(ref, rng), "noisy": permuted(near, rng), "left": permuted(ref, rng, experts=False)}
    models["less"] = {k: v for k, v in permuted(ref, rng).items() if "q_proj" not in k}
    tensors = spark.createDataFrame(rows_of(models), KIND).repartition(5)
    reference = spark.createDataFrame(rows_of({"r": ref}), KIND).drop("model").repartition(3)
    done, report = C.canonical(tensors, reference)
    got = {}
    for r in done.collect():
        got.setdefault(r.model, {}).setdefault(r.tensor, {})[r.slice, r.i] = r.row
    return ref, models, got, {(r.model, r.tensor): r for r in report.collect()}


def test_a_permuted_model_equals_its_original(laid_out):
    ref, models, got, _ = laid_out
    for m, tensors in models.items():
        assert set(got[m]) == set(tensors)
        for name in tensors:
            w = ref[name] if ref[name].ndim == 3 else ref[name][None]
            assert set(got[m][name]) == {(s, i) for s in range(w.shape[0]) for i in range(w.shape[1])}
            distance = max(float(np.abs(np.array(row) - w[k]).max()) for k, row in got[m][name].items())
            assert distance < (0.01 if m == "noisy" else 1e-12), (m, name)


def test_the_report_tells_what_was_moved(laid_out):
    *_, report = laid_out
    experts = "layers.0.mlp.experts.down_proj"
    assert report["moved", experts].realigned and report["noisy", experts].realigned and not report["left", experts].realigned and not report["same", experts].realigned
    assert all(report["same", t].same == 1 for m, t in report if m == "same")
    assert report["moved", "layers.0.self_attn.q_proj.weight"].same < 0.4 and report["moved", "layers.0.self_attn.q_proj.weight"].cos > 0.999
    assert ("less", "layers.0.self_attn.q_proj.weight") not in report and ("moved", "layers.0.odd.weight") not in report


def test_no_models(spark):
    none = spark.createDataFrame([], KIND)
    done, report = C.canonical(none, none.drop("model"))
    assert done.collect() == [] and report.collect() == []


def test_rows_that_want_the_same_column():
    cosine = np.array([[0.9, 0.1, 0.3], [0.8, 0.2, 0.7], [0.95, 0.5, 0.6]])
    assert linear.assigned(cosine)[0] == [1, 2, 0] or linear.assigned(cosine)[0] == [2, 1, 0]
    place, best, same = linear.assigned(np.eye(3)[[1, 2, 0]])
    assert place == [1, 2, 0] and best == 1 and same == 0


def test_nonnegative_gram_equals_the_best_of_all_supports():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 6)
        parts, target = rng.standard_normal((12, n)), rng.standard_normal(12)
        if rng.random() < 0.5:
            target = parts @ np.maximum(rng.standard_normal(n), 0)
        want, _ = linear.nonnegative_fit(target, parts)
        assert np.allclose(linear.nonnegative_gram(parts.T @ parts, parts.T @ target), want, atol=1e-8)
