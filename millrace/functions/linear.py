"""Numeric kernels on small groups: linkage, random-projection sketches, non-negative fits, spectra."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def average_linkage(vectors: list, cut: float) -> list[int]:
    """Cluster number of each vector: the pair of clusters with the highest mean cosine joins while it
    reaches the cut; of equal pairs the later one goes first.

    Two clusters reach the cut only if some pair of their members does, so each component of the pairs that
    reach it is clustered alone. Sums of cosines between clusters add up when two join, and each cluster
    keeps its best later partner, so a join costs a pass over its component.
    """
    x = np.asarray(vectors, float)
    if not len(x):
        return []
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    cosine = (x / np.where(norm == 0, 1, norm)) @ (x / np.where(norm == 0, 1, norm)).T
    label = np.arange(len(x))
    near = cosine >= cut - 1e-9
    while True:
        least = np.where(near, label[None, :], len(x)).min(1)
        least = np.minimum(least, label)
        if (least == label).all():
            break
        label = least
    out = np.arange(len(x))
    for c in np.unique(label):
        members = np.flatnonzero(label == c)
        if len(members) > 1:
            out[members] = members[_joined(cosine[np.ix_(members, members)], cut)]
    return np.unique(out, return_inverse=True)[1].tolist()


def _joined(sums: np.ndarray, cut: float) -> np.ndarray:
    """The first member of each one's cluster, for the cosines of one component."""
    n = len(sums)
    sums, size, head, live = sums.copy(), np.ones(n), np.arange(n), np.ones(n, bool)

    def best(i: int) -> tuple[float, int]:
        later = np.flatnonzero(live[i + 1 :]) + i + 1
        if not len(later):
            return -np.inf, -1
        mean = sums[i, later] / (size[i] * size[later])
        k = len(mean) - 1 - int(np.argmax(mean[::-1]))
        return float(mean[k]), int(later[k])

    partner = [best(i) for i in range(n)]
    while True:
        value, i, j = max((v, i, j) for i, (v, j) in enumerate(partner))
        if value < cut or j < 0:
            return head
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        live[j] = False
        head[head == j] = i
        partner[j] = (-np.inf, -1)
        for k in np.flatnonzero(live[: j + 1]):
            if k == i or partner[k][1] in (i, j):
                partner[k] = best(k)
            elif k < i and (m := sums[k, i] / (size[k] * size[i])) >= partner[k][0] and (m, i) > partner[k]:
                partner[k] = (float(m), int(i))


def sketch(w: np.ndarray, k: int = 64, samples: int = 2048, seed: int = 0) -> dict[str, np.ndarray | float]:
    """Two-sided Gaussian sketch of a matrix, some of its entries, and its norm."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, right = rng.standard_normal((k, w.shape[0])), rng.standard_normal((w.shape[1], k))
    flat = w.ravel()
    return {"s": left @ w @ right / k, "x": flat[rng.integers(0, flat.size, samples)], "wnorm": float(np.linalg.norm(w))}


def projected(sketches: list[np.ndarray], dim: int = 1024, seed: int = 1) -> np.ndarray:
    """One vector for a model: random projections of its sketches, summed and normed."""
    total = np.zeros(dim)
    for i, s in enumerate(sketches):
        rng = np.random.Generator(np.random.PCG64([seed, i]))
        total += rng.standard_normal((dim, s.size)) @ s.ravel() / np.sqrt(dim)
    n = np.linalg.norm(total)
    return total / n if n else total


def gavish_donoho(beta: float) -> float:
    """Optimal hard threshold for singular values, in medians of the observed ones, for a matrix of shape ratio beta.

    The threshold of known noise over the root of the median of the noise's own distribution of squared singular values, found by
    adding up its density on a fine grid (substituted so that the ends of the support are smooth).
    """
    edge = np.sqrt(2 * (beta + 1) + 8 * beta / (beta + 1 + np.sqrt(beta**2 + 14 * beta + 1)))
    low, high = (1 - np.sqrt(beta)) ** 2, (1 + np.sqrt(beta)) ** 2
    angle = np.linspace(0, np.pi, 200_001)
    x = low + (high - low) * (1 - np.cos(angle)) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        density = np.nan_to_num(np.sqrt((high - x) * (x - low)) / x * np.sin(angle), nan=0.0, posinf=0.0)
    mass = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2)))
    return float(edge / np.sqrt(np.interp(mass[-1] / 2, mass, x)))


def spectrum(delta: np.ndarray) -> dict[str, float]:
    """How much of a change lies in singular values above the noise threshold."""
    s = np.linalg.svd(delta, compute_uv=False)
    cut = gavish_donoho(min(delta.shape) / max(delta.shape)) * float(np.median(s))
    energy = float((s**2).sum())
    return {"structured": float((s[s > cut] ** 2).sum() / energy) if energy else 0.0, "spikes": float((s > cut).sum())}


def nonnegative_fit(target: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, float]:
    """Non-negative coefficients of the best fit over all supports, and the relative residual."""
    n = parts.shape[1]
    best, best_error = np.zeros(n), float(np.linalg.norm(target))
    for size in range(1, n + 1):
        for support in combinations(range(n), size):
            c, *_ = np.linalg.lstsq(parts[:, support], target, rcond=None)
            if (c >= 0).all():
                error = float(np.linalg.norm(target - parts[:, support] @ c))
                if error < best_error - 1e-12:
                    best, best_error = np.zeros(n), error
                    best[list(support)] = c
    whole = float(np.linalg.norm(target))
    return best, best_error / whole if whole else 0.0


def matched_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a one row of b, by cosine, strongest pairs first, each row used once."""
    na, nb = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (a, b))
    cosine = na @ nb.T
    out = np.full(len(a), -1)
    free = np.ones(len(b), bool)
    for flat in np.argsort(-cosine, axis=None, kind="stable"):
        i, j = divmod(int(flat), len(b))
        if out[i] < 0 and free[j]:
            out[i], free[j] = j, False
    return out


def assigned(cosine: np.ndarray) -> tuple[list[int], float, float]:
    """For each row of a table of cosines the column that it gets, no column twice while some are free; the mean of
    the rows' best cosines, and the share of rows that get the column of their own number.

    Rows choose in the order of their best cosine; one whose choice is taken gets the best column left.
    """
    best, first = cosine.max(1), cosine.argmax(1)
    if len(np.unique(first)) == len(first):
        place = first
    else:
        place, left = np.zeros(len(cosine), np.int64), np.ones(cosine.shape[1], bool)
        for j in np.argsort(-best, kind="stable"):
            place[j] = first[j] if left[first[j]] or not left.any() else np.argmax(np.where(left, cosine[j], -2.0))
            left[place[j]] = False
    return place.tolist(), float(best.mean()), float((place == np.arange(len(cosine))).mean())


def one_to_one(a: np.ndarray, b: np.ndarray) -> tuple[list[int], float, float]:
    """`assigned` for the rows of b and the rows of a, by cosine."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return assigned(unit(b) @ unit(a).T)


def nonnegative_gram(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Non-negative x that makes x'Gx/2 - r'x least: an active set, freed where the gradient says so and left
    where a step would turn negative."""
    n = len(rhs)
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1e-300, float(np.abs(rhs).max(initial=0)))
    for _ in range(30 * n):
        slope = rhs - gram @ x
        slope[free] = -np.inf
        j = int(slope.argmax()) if n else 0
        if not n or slope[j] <= 1e-12 * scale:
            break
        free[j] = True
        while True:
            y = np.zeros(n)
            y[free] = np.linalg.lstsq(gram[np.ix_(free, free)], rhs[free], rcond=None)[0]
            if (y[free] > 0).all():
                break
            down = free & (y <= 0)
            step = (x[down] / np.maximum(x[down] - y[down], 1e-300)).min(initial=1.0)
            x = x + step * (y - x)
            free &= x > 1e-14 * max(1.0, float(np.abs(x).max()))
            x[~free] = 0
            if not free.any():
                y = x
                break
        x = y
    return x
