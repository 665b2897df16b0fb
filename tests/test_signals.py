"""Measures and verdicts on fingerprints against plain arithmetic on their matrices."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.functions.linear import gavish_donoho, nonnegative_fit
from millrace.operators import signals as S

K = 32
NAMES = [
    "embed_tokens.weight", "lm_head.weight", "layers.0.self_attn.q_proj.weight", "layers.0.linear_attn.in_proj_qkv.weight",
    "layers.0.mlp.shared_expert.up_proj.weight", "layers.0.mlp.experts.gate_up_proj", "layers.1.self_attn.q_proj.weight", "norm.weight",
]


def base(seed):
    rng = np.random.default_rng(seed)
    return {n: (rng.standard_normal((K, K)), rng.standard_normal(256)) for n in NAMES}


def changed(m, sketch, sample=lambda n, x: x):
    return {n: (sketch(n, s), sample(n, x)) for n, (s, x) in m.items()}


def low_rank(rng, scale, r=4):
    return rng.standard_normal((K, r)) @ rng.standard_normal((r, K)) * scale


@pytest.fixture(scope="module")
def models():
    rng = np.random.default_rng(9)
    root = base(0)
    dense = lambda n, x: x + rng.standard_normal(len(x)) * 0.01
    body = lambda n, s: s + (low_rank(rng, 0.1) if "embed" not in n and "head" not in n else low_rank(rng, 0.004))
    a, b = changed(root, body, dense), changed(root, body, dense)

    def sparse(n, x):
        x = x.copy()
        x[:10] += 0.5
        return x

    cands = {
        "copy": changed(root, lambda n, s: s), "noise": changed(root, lambda n, s: s + rng.standard_normal((K, K)) * 0.05, dense),
        "dense": changed(root, lambda n, s: s + low_rank(rng, 0.05), dense), "blend": {n: (0.6 * a[n][0] + 0.4 * b[n][0], a[n][1]) for n in NAMES},
        "trivial": changed(a, lambda n, s: s + low_rank(rng, 1e-4) * ("embed" not in n and "head" not in n), dense),
        "sparse": changed(a, body, sparse), "trained": changed(a, body, dense),
        "scaled": changed(changed(a, body, dense), lambda n, s: s * 1.5 if n == "lm_head.weight" else s), "part": {n: v for n, v in changed(a, body, dense).items() if "layers.1" not in n},
    }
    return cands, {"root": root, "a": a, "b": b}


def frame(spark, models):
    rows = [(m, n, s.ravel().tolist(), x.tolist()) for m, t in models.items() for n, (s, x) in t.items()]
    return spark.createDataFrame(rows, "model string, tensor string, sketch array<double>, samples array<double>").repartition(4)


def plain(cand, bank):
    """The measures by loops over matrices."""
    shared = {b: [n for n in sorted(m) if n in cand] for b, m in bank.items()}
    dist = {b: (sum(((cand[n][0] - bank[b][n][0]) ** 2).sum() for n in shared[b]) / sum((bank[b][n][0] ** 2).sum() for n in shared[b])) ** 0.5 for b in bank}
    order = sorted(dist, key=lambda b: (dist[b], b))
    anc = bank[order[0]]
    types, scales, spikes, moved = {}, [], [], []
    energy = delta_all = delta_live = anchor_all = 0.0
    for n in shared[order[0]]:
        s, r = cand[n][0], anc[n][0]
        scale = (s * r).sum() / (r * r).sum()
        d = s - scale * r
        t = types.setdefault(next((t for t in S.TYPES if t in n), "other"), [0.0, 0.0])
        t[0] += (r * r).sum()
        anchor_all, delta_all = anchor_all + (r * r).sum(), delta_all + (d * d).sum()
        z = cand[n][1] - anc[n][1]
        if z.any():
            moved.append(((z != 0).mean(), (((z - z.mean()) / z.std()) ** 4).mean() - 3))
        if (s == r).all():
            continue
        scales.append(scale)
        t[1] += (d * d).sum()
        v = np.linalg.svd(d, compute_uv=False)
        high = v[v > np.median(v) * gavish_donoho(1.0)]
        spikes.append(len(high))
        energy, delta_live = energy + (high**2).sum(), delta_live + (d * d).sum()
    rel = {k: (d / a) ** 0.5 for k, (a, d) in types.items()}
    ratio = np.mean([rel[t] for t in S.EMBEDDINGS if t in rel]) / max(np.mean([rel[t] for t in S.BODY if t in rel]), 1e-12)
    vec = lambda m: np.concatenate([(m[n][0] - anc[n][0]).ravel() for n in shared[order[0]]])
    alpha, resid = nonnegative_fit(vec(cand), np.stack([vec(bank[b]) for b in order[1:]], axis=1)) if vec(cand).any() else (None, None)
    structured, size = energy / delta_live if delta_live else 0.0, (delta_all / anchor_all) ** 0.5
    return {
        "ancestor": order[0], "dist": dist[order[0]], "structured": structured, "rel": size, "rel_struct": structured**0.5 * size, "embed_ratio": ratio,
        "spikes_med": np.median(spikes) if spikes else 0.0, "touched": len(spikes), "global_scale": np.median(scales) if scales else 1.0,
        "density": np.median([m[0] for m in moved]) if moved else 0.0, "kurtosis": np.median([m[1] for m in moved]) if moved else 0.0,
        "alpha": alpha, "resid": resid, "partners": order[1:],
    }


def test_measures_and_verdicts(spark, models):
    cands, bank = models
    near = spark.createDataFrame([(m, b) for m in cands for b in bank], "model string, of string")
    rows = {r.model: r for r in S.verdicts(frame(spark, cands), frame(spark, bank), near).collect()}
    assert set(rows) == set(cands)
    for m, r in rows.items():
        want = plain(cands[m], bank)
        assert r.ancestor == want["ancestor"]
        for k in ("dist", "structured", "rel", "rel_struct", "embed_ratio", "spikes_med", "touched", "global_scale", "density", "kurtosis"):
            assert getattr(r, k) == pytest.approx(want[k], abs=1e-6), (m, k)
        if want["resid"] is not None:
            assert r.partners == want["partners"] and r.alpha == pytest.approx(want["alpha"].tolist(), abs=1e-6) and r.resid == pytest.approx(want["resid"], abs=1e-6)
    reasons = {m: r.reason for m, r in rows.items()}
    assert reasons == {
        "copy": "COPY", "noise": "NOISE-COPY", "dense": "NOISED-COPY", "blend": "LINEAR-COMBO", "trivial": "TRIVIAL-EDIT", "sparse": "SPARSE-EDIT",
        "trained": None, "scaled": None, "part": None,
    }
    assert rows["scaled"].head_scale == pytest.approx(1.5, abs=0.01) and rows["trained"].kind == "LORA-like" and rows["trained"].status == "PASS"


def test_no_neighbours(spark, models):
    cands, bank = models
    none = spark.createDataFrame([], "model string, of string")
    assert S.verdicts(frame(spark, cands), frame(spark, bank), none).collect() == []
