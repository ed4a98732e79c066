"""Gradient-boosted trees for two classes: fitted in numpy, evaluated in numpy or as a SQL expression."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> dict:
    """Logistic loss, second-order leaf values, complete trees of ``depth`` levels, cuts at quantiles of each feature.

    The model is a dict of arrays: prior, feature and cut of each inner node in heap order, value of each leaf. Without
    rows the prior is 0; with one class the trees are flat.
    """
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    n, width = (len(x), x.shape[1] if x.ndim == 2 else 1)
    share = min(max((y.sum() + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    model = {"prior": prior, "feature": np.zeros((trees, inner), dtype=int), "cut": np.full((trees, inner), np.inf), "value": np.zeros((trees, leaves)), "depth": depth}
    if not n:
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    place = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # at most cut k <=> place <= k
    total = np.full(n, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=int)
        for level in range(depth):
            first, width_now = (1 << level) - 1, 1 << level
            best = np.full(width_now, 1e-6)
            for f in range(width):
                k = len(cuts[f])
                if not k:
                    continue
                cell = node * (k + 1) + place[:, f]
                gs = np.bincount(cell, g, width_now * (k + 1)).reshape(width_now, k + 1).cumsum(axis=1)
                hs = np.bincount(cell, h, width_now * (k + 1)).reshape(width_now, k + 1).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + least) + (ga - gl) ** 2 / (ha - hl + least) - ga**2 / (ha + least)
                at = gain.argmax(axis=1)
                top = gain[np.arange(width_now), at]
                for m in np.flatnonzero(top > best):
                    best[m] = top[m]
                    model["feature"][t, first + m], model["cut"][t, first + m] = f, cuts[f][at[m]]
            feature, cut = model["feature"][t, first + node], model["cut"][t, first + node]
            node = 2 * node + (x[np.arange(n), feature] > cut)
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        model["value"][t] = rate * gs / (hs + least)
        total += model["value"][t][node]
    return model


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of each row."""
    x = np.asarray(x, dtype=float)
    total, rows = np.full(len(x), model["prior"]), np.arange(len(x))
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"]):
        node = np.zeros(len(x), dtype=int)
        for level in range(model["depth"]):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, feature[at]] > cut[at])
        total += value[node]
    return total


def chance(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin(model, x)))


def sql(model: dict, names: list[str]) -> str:
    """The log odds as a SQL expression over columns or fields of these names."""

    def node(t: int, level: int, at: int) -> str:
        if level == model["depth"]:
            return repr(float(model["value"][t, at])) + "D"
        here = (1 << level) - 1 + at
        cut = model["cut"][t, here]
        if not np.isfinite(cut):
            return node(t, level + 1, 2 * at)
        return f"IF({names[model['feature'][t, here]]} > {float(cut)!r}D, {node(t, level + 1, 2 * at + 1)}, {node(t, level + 1, 2 * at)})"

    parts = [node(t, 0, 0) for t in range(len(model["value"]))]
    return " + ".join([repr(model["prior"]) + "D", *parts])


def threshold(scores: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The least score from which on held-back rows reach ``precision``; infinite if none does."""
    order = np.argsort(-scores, kind="stable")
    scores, right = scores[order], np.cumsum(truth[order])
    good = right >= precision * np.arange(1, len(scores) + 1)
    good &= np.append(scores[1:] != scores[:-1], True)
    return float(scores[np.flatnonzero(good)[-1]]) if good.any() else float("inf")
